"""The ten corpus queries: each applies its operator to the whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcurve.llm import classifier, decontaminate, html, licenses, minhash, packing, quality, secrets, shuffle, warc
from wearcurve.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_parts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shuffle.sharded(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    failed = F.col("failed_bits").bitwiseAND(F.lit(quality.policy_mask("base"))) != 0
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failed_bits")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = classifier.scored(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc.round_trip(table(spark, sf_dir, "pages"))
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_decontamination, op3_packing, op4_license_scan, op5_sharding, op6_quality_rules, op7_quality_classifier, op8_warc, op9_minhash_dedup, op10_html_extraction)}
