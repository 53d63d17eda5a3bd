"""Helpers shared by the corpus operators: shared storage, inputs and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters 0x09 to 0x0D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: A side with at most this many rows (of at most a few dozen bytes each) may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; it goes when the session ends.

    Where the setting is absent (local tests) a temporary folder is set; elsewhere that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            top = held.get()
        elif spark.sparkContext.master.startswith("local["):
            top = "file://" + tempfile.mkdtemp(prefix="wearcurve-")
            spark.sparkContext.setCheckpointDir(top)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "://" not in top and top.startswith("/"):
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)).toString()
    path = f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession, what)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """df, marked for broadcast if it has at most so many rows, and its number of rows. df should be stored(); wide rows need a lower limit."""
    n = df.count()
    return (F.broadcast(df) if n <= rows else df), n
