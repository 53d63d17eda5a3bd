"""Sharding by a two-pass external shuffle.

Pass one scatters the records, by seeded hashes, into buckets that fit into memory; each bucket is one partition of a shuffle. Pass two takes
one bucket at a time, orders it by content, shuffles it by Fisher-Yates with a seed of its own, and gives out the slots after those of the
shard's earlier buckets. write_shards() writes each dealt bucket as one file of its shard, so the names of a shard's files follow its slots.
A retried task gives the same order again. The table is read twice (for the sizes of the buckets and for the records), so it must give the same rows each time.

The shard follows the `key` law: the key and the number of shards decide. Shard j takes a key when hash(key, j)
is divisible by j + 1, and the last such j wins; so one more shard takes rows only into itself.

Defined results: a null text has 0 bytes (size 1, checksum 0); rows with a null key share one shard; repeated rows
get a slot each; other columns are carried only if named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcurve.llm.common import shared_dir, small, stored

#: What a task holds at once: so many rows, and of carried records about so many bytes of text.
ROWS_PER_BUCKET, BYTES_PER_BUCKET = 8192, 64 << 20
SEED = 20_240_607


def shard_of(key: str, n: int, seed: int = SEED) -> Column:
    return F.array_max(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.pmod(F.xxhash64(F.col(key), F.lit(seed), j), (j + 1).cast("long")) == 0))


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """Slots of n records: swap each place, from the last, with one at or before it."""
    order = list(range(n))
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    slots = np.empty(n, np.int64)
    slots[order] = np.arange(n)
    return slots


def grown_shard_of(key: str, n: int, seed: int = SEED) -> Column:
    """The shard of n + 1 shards."""
    return F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(n)), F.lit(n + 1).cast("long")) == 0, F.lit(n)).otherwise(shard_of(key, n, seed))


def size_of(text: str = "text") -> Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def crc32_of(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def shuffled(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 8, carry: tuple[str, ...] = (), rows_per_bucket: int = ROWS_PER_BUCKET, seed: int = SEED) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard, slot, and carried (a struct of the columns named in carry): one row per row of df. The memory of a task is that of rows_per_bucket records."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(size_of(text)), F.lit(0)) if carry else F.lit(0)).first()
    buckets = max(1, math.ceil(max(rows / rows_per_bucket, size / BYTES_PER_BUCKET) / n_shards))
    d = df.select(F.col(key), *([F.struct(*carry).alias("carried")] if carry else []), size_of(text).alias("size"), crc32_of(text).alias("text_crc32"))
    d = d.select(
        "*",
        shard_of(key, n_shards, seed).alias("shard"),
        grown_shard_of(key, n_shards, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(key), F.col("text_crc32"), F.lit(seed + 1)), F.lit(buckets).cast("long")).cast("int").alias("bucket"),
    )
    sizes = stored(d.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "bucket-sizes")
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    starts, _ = small(starts)
    out = T.StructType([*[f for f in d.schema if f.name != "bucket"], T.StructField("slot", T.LongType())])
    d = d.withColumn("tie", F.xxhash64("carried") if carry else F.lit(0).cast("long"))
    order = [(key, "ascending"), ("text_crc32", "ascending"), ("size", "ascending"), ("tie", "ascending")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one bucket
        if sum(b.num_rows for b in held):
            t = pa.Table.from_batches(held).sort_by(order)
            held.clear()
            shard, bucket, start = (t.column(c)[0].as_py() for c in ("shard", "bucket", "start"))
            slots = fisher_yates(t.num_rows, np.random.default_rng([seed, shard, bucket])) + start
            t = t.append_column("slot", pa.array(slots, pa.int64())).select([f.name for f in out])
            yield from t.to_batches(max_chunksize=1024)

    place = F.col("shard") * buckets + F.col("bucket")
    return d.join(starts, ["shard", "bucket"]).repartitionById(n_shards * buckets, place).mapInArrow(deal, out)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", n_shards: int = 8, slot: str | None = None, **more) -> None:
    """All columns of df, as shard_no=N folders of Parquet in slot order (df must not have that column); with the slot as one more column if slot names it."""
    d = shuffled(df, key, text, n_shards, tuple(df.columns), **more).select(F.col("shard").alias("shard_no"), "slot", "carried")
    d = d.sortWithinPartitions("shard_no", "slot").select("carried.*", *([F.col("slot").alias(slot)] if slot else []), "shard_no")
    d.write.partitionBy("shard_no").parquet(path)


def sharded(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 8, **more) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard, slot of the records as they are in shards written below the shared folder (df must not have the columns shard_no and slot_no)."""
    path = f"{shared_dir(df.sparkSession, 'shards')}/t"
    write_shards(df, path, key, text, n_shards, slot="slot_no", **more)
    back = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("slot_no", T.LongType()), T.StructField("shard_no", T.IntegerType())])).parquet(path)
    return back.select(F.col(key), size_of(text).alias("size"), crc32_of(text).alias("text_crc32"), F.col("shard_no").alias("shard"), grown_shard_of(key, n_shards, more.get("seed", SEED)).alias("grown_shard"), F.col("slot_no").alias("slot"))
