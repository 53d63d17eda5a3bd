"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs.

Defined results: documents without words fail the quality rules, so null and empty texts end there. Documents with a null doc_id take no part in
the search for duplicates and benchmark passages (they can't be named) and stay. Of kept rows with one doc_id (whatever their texts) one stays.
Empty tables give empty results; columns that documents have besides are carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcurve.llm import common, decontaminate, minhash, packing, quality, secrets


def _without(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs (with their columns in order) of which ids has the doc_id (left_semi) or hasn't (left_anti)."""
    ids, _ = common.small(common.stored(ids.select("doc_id").distinct(), "ids"))
    return docs.join(ids, "doc_id", how).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    rows = docs.select(F.struct("*").alias("row"), "text")  # as one column, so that no name clashes with a measurement
    return quality.apply_policy(quality.ledger(rows, keep=("row",)), "v1").where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id."""
    gone = minhash.near_duplicates(docs).where("NOT kept")
    kept = _without(docs, gone, "left_anti")
    named = kept.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return named.dropDuplicates(["doc_id"]).union(kept.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _without(docs, decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark")), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text."""
    d = secrets.redact(docs)
    return d.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else d


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing_stage),
]
#: Near-duplicates, alignments and packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
