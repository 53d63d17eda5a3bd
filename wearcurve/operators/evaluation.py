"""Scores of predictions against actual remaining life, and of alarms against failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))


def nasa_penalty(d: Column) -> Column:
    """Early by 13 or late by 10 steps costs e - 1; at most 1e6 an observation."""
    p = F.when(d < 0, F.exp(F.least(-d / 13, F.lit(20.0))) - 1).otherwise(F.exp(F.least(d / 10, F.lit(20.0))) - 1)
    return F.least(p, F.lit(1e6))


def rul_aggregates(predicted: str = "predicted_rul", actual: str = "actual_rul") -> dict[str, Column]:
    """n_valid, rmse, mae, nasa_score, mean_bias over rows where both are finite; nulls where there is none."""
    d = F.when(finite(predicted) & finite(actual), F.col(predicted) - F.col(actual))
    return {"n_valid": F.count(d), "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "nasa_score": F.sum(F.when(d.isNotNull(), nasa_penalty(d))), "mean_bias": F.avg(d)}


def detection_aggregates(alarm: str = "alarm", failure: str = "failure_index") -> dict[str, Column]:
    """detection_lead_time, detection_success, false_alarm_rate: alarms before the failure, and their share in the first quarter (0 if it's empty). All null without a failure."""
    f, a = F.max(failure), F.min(F.when((F.col(alarm) > 0) & (F.col("t") < F.col(failure)), F.col("t")))
    rate = F.coalesce(F.avg(F.when(F.col("t") < F.floor(F.col("n") / 4), F.coalesce(F.col(alarm), F.lit(0)).cast("double"))), F.lit(0.0))
    return {"detection_lead_time": (f - a).cast("long"), "detection_success": F.when(f.isNotNull(), a.isNotNull()), "false_alarm_rate": F.when(f.isNotNull(), rate)}


def _grouped(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggregates.items()])


def rul_metrics(df: DataFrame, keys: list[str], predicted: str = "predicted_rul", actual: str = "actual_rul") -> DataFrame:
    return _grouped(df, keys, rul_aggregates(predicted, actual))


def detection_metrics(df: DataFrame, keys: list[str], alarm: str = "alarm", failure: str = "failure_index") -> DataFrame:
    return _grouped(df, keys, detection_aggregates(alarm, failure))


def compare_models(df: DataFrame) -> DataFrame:
    """A row for each model (model, t, n, predicted_rul, actual_rul, alarm, failure_index), the smallest rmse first and missing ones last. One pass over the tracks."""
    return _grouped(df, ["model"], rul_aggregates() | detection_aggregates()).orderBy(F.asc_nulls_last("rmse"), "model")
