"""Normalisation, smoothing, healthy levels and fleet averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcurve.operators.units import by_unit, trailing


def minmax(value: str) -> Column:
    """Within the unit, to 0..1; a constant unit becomes 0."""
    low, high = F.min(value).over(by_unit()), F.max(value).over(by_unit())
    return (F.col(value) - low) / F.when(high - low < 1e-8, F.lit(1.0)).otherwise(high - low)


def smooth(value: str, rows: int = 5) -> Column:
    return F.avg(value).over(trailing(rows))


def train_normalised(df: DataFrame, sensors: list[str], is_train: Column) -> DataFrame:
    """Each sensor scaled by the range of the training rows; the ranges are one row, so they are joined without a shuffle."""
    aggs = [f(F.when(is_train, F.col(s))).alias(f"_{n}_{s}") for s in sensors for n, f in (("lo", F.min), ("hi", F.max))]
    width = lambda s: F.col(f"_hi_{s}") - F.col(f"_lo_{s}")
    scaled = {s: (F.col(s) - F.col(f"_lo_{s}")) / F.when(width(s) == 0, F.lit(1e-8)).otherwise(width(s)) for s in sensors}
    return df.crossJoin(F.broadcast(df.agg(*aggs))).withColumns(scaled).select(df.columns)


def row_mean(columns: list[str]) -> Column:
    """Over the values that are there (neither null nor NaN)."""
    good = [F.when(~F.isnan(c), F.col(c)) for c in columns]
    count = sum((g.isNotNull().cast("int") for g in good[1:]), good[0].isNotNull().cast("int"))
    total = sum((F.coalesce(g, F.lit(0.0)) for g in good[1:]), F.coalesce(good[0], F.lit(0.0)))
    return F.when(count > 0, total / count)


def healthy_threshold(df: DataFrame, value: str, share: float = 0.1, sigmas: float = 5.0) -> DataFrame:
    """df + healthy_mean + threshold: mean and 5 deviations of the first tenth of the unit (one row at least); mean + 1 where that isn't above the mean."""
    early = F.when(F.col("t") < F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n"))), F.col(value))
    mean, dev = F.avg(early).over(by_unit()), F.stddev_pop(early).over(by_unit())
    d = df.withColumn("healthy_mean", mean).withColumn("_dev", dev)
    level = F.col("healthy_mean") + sigmas * F.col("_dev")
    return d.withColumn("threshold", F.when(level > F.col("healthy_mean"), level).otherwise(F.col("healthy_mean") + 1)).drop("_dev")


def scaled_baseline(curve: Column) -> Column:
    """A 0..1 curve between healthy mean and threshold."""
    return F.col("healthy_mean") + curve * (F.col("threshold") - F.col("healthy_mean"))


def fleet_prior(df: DataFrame, value: str) -> DataFrame:
    """back (rows before the end), t (from the start of the longest unit) and the mean over units, which are aligned at their ends; a shorter unit counts with its first value before its start.

    Only one row a unit and place would be needed, so places before the start aren't made: their sum is that of the first values of all units that are shorter.
    """
    d = df.withColumn("back", F.col("n") - 1 - F.col("t"))
    own = d.groupBy("back").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    firsts = d.where("t = 0").groupBy(F.col("n").alias("back")).agg(F.sum(value).alias("fs"), F.count(value).alias("fc"))
    from pyspark.sql import Window

    # places are as many as the longest unit has rows, whatever the number of units
    w = Window.orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    both = own.join(firsts, "back", "left")
    run = both.select("back", "s", "c", F.coalesce(F.sum("fs").over(w), F.lit(0.0)).alias("fs"), F.coalesce(F.sum("fc").over(w), F.lit(0)).alias("fc"), F.max("back").over(Window.partitionBy()).alias("last"))
    return run.select((F.col("last") - F.col("back")).alias("t"), "back", ((F.col("s") + F.col("fs")) / (F.col("c") + F.col("fc"))).alias("prior"))
