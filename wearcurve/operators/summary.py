"""Summaries of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PID = ["pid_adaptive", "pid_regime"]


def cross_dataset_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset", "model").agg(
        F.min("equipment_type").alias("equipment_type"), F.min("prior_quality").alias("prior_quality"), F.count_distinct("unit_id").alias("n_units"),
        F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"),
        F.avg("detection_lead_time").alias("mean_lead_time"), F.avg(F.col("detection_success").cast("int")).alias("success_rate"),
    ).orderBy("dataset", F.asc_nulls_last("mean_rmse"), "model")


def prior_quality_comparison(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("model").isin(PID)).groupBy("prior_quality").agg(F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.avg("mae").alias("mean_mae"), F.count_distinct("unit_id").alias("n_units"))


def improvement(before: str, after: str) -> Column:
    return (F.col(before) - F.col(after)) / F.col(before) * 100


def regime_benefit(rows: DataFrame, how: str = "full") -> DataFrame:
    """dataset, pid_adaptive, pid_regime (mean mae), improvement in percent. full: data sets with one of the models stay, with a null."""
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("mae")))
    has = lambda m: F.max((F.col("model") == m).cast("int"))
    d = rows.where(F.col("model").isin(PID)).groupBy("dataset").agg(*[mean(m).alias(m) for m in PID], *[has(m).alias(f"_{m}") for m in PID])
    if how == "inner":
        d = d.where("_pid_adaptive = 1 AND _pid_regime = 1")
    return d.select("dataset", *PID, improvement(*PID).alias("improvement_pct"))


def model_summary(rows: DataFrame, keys: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    return rows.groupBy(*keys).agg(
        F.count_distinct("unit_id").alias("n_units"), F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"), F.avg("nasa_score").alias("mean_nasa"), F.avg("mean_bias").alias("mean_bias"), F.avg("detection_lead_time").alias("mean_lead_time")
    )


def multi_stat(rows: DataFrame, metrics: list[str], keys: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    return rows.groupBy(*keys).agg(*[f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))])


def pivoted(rows: DataFrame, key: str, column: str, values: list[str], metric: str) -> DataFrame:
    """A row for each key, a column for each value: mean of the metric."""
    return rows.groupBy(key).agg(*[F.avg(F.when(F.col(column) == v, F.col(metric))).alias(v) for v in values])


def pivoted_many(rows: DataFrame, key: str, column: str, values: list[str], metrics: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(*[F.avg(F.when(F.col(column) == v, F.col(m))).alias(f"{v}_{m}") for v in values for m in metrics])


def describe(rows: DataFrame, key: str, metric: str) -> DataFrame:
    q = lambda p: F.percentile(metric, F.lit(p))
    return rows.groupBy(key).agg(F.count(metric).alias("count"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(metric).alias("max"))


def zero_shot_gap(rows: DataFrame, zero_shot: str = "pid_adaptive", refit: str = "rolling_refit") -> DataFrame:
    """Per data set: rmse without training against that of the refits, and the gap in percent of the latter."""
    return pivoted(rows, "dataset", "model", [zero_shot, refit], "rmse").withColumn("gap_pct", F.bround((F.col(zero_shot) - F.col(refit)) / F.col(refit) * 100, 1))


def percentile_units(lengths: DataFrame, percentiles: list[float]) -> DataFrame:
    """unit_id, n: the units whose lengths are closest to the percentiles of all lengths, each once; the smaller id of equals."""
    ps = lengths.agg(F.percentile("n", F.array(*[F.lit(p) for p in percentiles])).alias("p")).select(F.posexplode("p").alias("k", "target"))
    d = lengths.crossJoin(F.broadcast(ps))  # as many rows as percentiles
    return d.groupBy("k").agg(F.min_by(F.struct("unit_id", "n"), F.struct(F.abs(F.col("n") - F.col("target")), F.col("unit_id"))).alias("u")).select("u.unit_id", "u.n").distinct()


def length_stats(lengths: DataFrame, keys: list[str]) -> DataFrame:
    return lengths.groupBy(*keys).agg(F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"), F.count("*").alias("n_units"))


def completeness(params: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_present, n_rows, share: one pass, then a row for each field."""
    d = params.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in fields])
    return d.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_present")) for c in fields])).alias("x")).select("x.field", "x.n_present", "n_rows", (F.col("x.n_present") / F.col("n_rows")).alias("share"))


def labelled_lead_times(rows: DataFrame) -> DataFrame:
    """label ("dataset / model"), mean_lead_time, in rising order."""
    d = rows.where(F.col("detection_lead_time").isNotNull()).groupBy("dataset", "model").agg(F.avg("detection_lead_time").alias("mean_lead_time"))
    return d.select(F.concat_ws(" / ", "dataset", "model").alias("label"), "mean_lead_time").orderBy("mean_lead_time", "label")


def published_comparison(rows: DataFrame) -> DataFrame:
    """method, rmse, needs_training: published results (fixed values) and our means."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([("LSTM", 16.14, True), ("CNN-LSTM", 12.83, True), ("Transformer", 11.87, True)], "method string, rmse double, needs_training boolean")
    ours = rows.where(F.col("model").isin(PID)).groupBy(F.col("model").alias("method")).agg(F.avg("rmse").alias("rmse")).withColumn("needs_training", F.lit(False))
    return fixed.unionByName(ours)
