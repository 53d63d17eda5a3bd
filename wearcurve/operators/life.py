"""Actual remaining life, as columns over a trajectory (unit_id, t, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcurve.operators.units import by_unit


def ramp(failure: Column, t: str = "t") -> Column:
    """Steps to failure, not below 0; null without one."""
    return F.when(failure.isNotNull(), F.greatest(F.lit(0.0), (failure - F.col(t)).cast("double")))


def hours_left(time: str = "hours") -> Column:
    return F.max(time).over(by_unit()) - F.col(time)


def linear(t: str = "t", n: str = "n") -> Column:
    """From n down to 0 in even steps."""
    return F.when(F.col(n) > 1, F.col(n) * (1 - F.col(t) / (F.col(n) - 1))).otherwise(F.col(n).cast("double"))


def capped(cycle: str = "t", cap: float = 125.0) -> Column:
    return F.least((F.max(cycle).over(by_unit()) - F.col(cycle)).cast("double"), F.lit(cap))


def test_offset(last: Column, t: str = "t", n: str = "n", cap: float = 125.0) -> Column:
    """A given life at the last row, and one more for each row before it, between 0 and cap."""
    return F.greatest(F.lit(0.0), F.least((last + (F.col(n) - 1 - F.col(t))).cast("double"), F.lit(cap)))


def end_of_life(df: DataFrame, health: str, least: float = 0.8) -> DataFrame:
    """df + failure_index (the first t with health below least; null if none) + true_rul (null without failure)."""
    fail = F.min(F.when(F.col(health) < least, F.col("t"))).over(by_unit())
    return df.withColumn("failure_index", fail).withColumn("true_rul", F.when(F.col("failure_index").isNotNull(), ramp(F.col("failure_index"))))


def phase(health: str) -> Column:
    """Linear fade above 0.85, knee above 0.75, rapid fade below."""
    return F.when(F.col(health) > 0.85, "linear").when(F.col(health) >= 0.75, "knee").otherwise("rapid")


def deviation_quarters(df: DataFrame, observed: str, expected: str) -> DataFrame:
    """Per unit: the mean deviation over the first and the last quarter of its rows."""
    d = F.col(observed) - F.col(expected)
    return df.groupBy("unit_id").agg(
        F.avg(F.when(F.col("t") < F.floor(F.col("n") / 4), d)).alias("first_quarter"),
        F.avg(F.when(F.col("t") >= F.floor(3 * F.col("n") / 4), d)).alias("last_quarter"),
    )
