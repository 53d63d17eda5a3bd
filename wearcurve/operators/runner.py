"""The benchmark: every model over every unit, scored in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcurve.kernels import fit
from wearcurve.operators import evaluation, life, models, trackers

MODELS = ["threshold_alarm", "static_curve", "rolling_refit", "pid_adaptive", "pid_regime"]
ALARM_BELOW = 50.0
#: Fixed schema of the result rows.
RESULT = "dataset string, unit_id string, model string, prior_quality string, equipment_type string, is_run_to_failure boolean, n_valid bigint, rmse double, mae double, nasa_score double, mean_bias double, detection_lead_time bigint, false_alarm_rate double, detection_success boolean"


def level_or_one(c: str = "threshold"):
    """A threshold of 0 counts as none; none is 1."""
    return F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0))


def model_tracks(df: DataFrame, wanted: list[str] | None = None, grid: bool = False, keep: tuple[str, ...] = (), rounds: int = fit.ROUNDS) -> DataFrame:
    """unit_id, t, keep, model, predicted_rul, alarm. df: unit_id, t, n, observed, baseline (null: no prior), threshold.

    Units without a prior get no controller; units of fewer than 50 rows no rolling refit.
    """
    wanted = wanted or MODELS
    d = df.withColumn("threshold", level_or_one())
    prior = d.where(F.col("baseline").isNotNull())
    made = {
        "threshold_alarm": lambda: models.threshold_alarm(d, "observed", keep=keep).select("unit_id", "t", *keep, F.lit(None).cast("double").alias("predicted_rul"), "alarm"),
        "static_curve": lambda: models.static_curve(d, "observed", grid=grid, keep=keep, rounds=rounds),
        "rolling_refit": lambda: models.rolling_refit(d.where("n >= 50"), "observed", grid=grid, keep=keep, rounds=rounds),
        "pid_adaptive": lambda: trackers.pid_track(prior, keep=keep),
        "pid_regime": lambda: trackers.pid_regime_track(prior, keep=keep),
    }
    parts = []
    for name in wanted:
        p = made[name]()
        if name != "threshold_alarm":
            p = p.withColumn("alarm", F.coalesce(F.col("predicted_rul") < ALARM_BELOW, F.lit(False)).cast("int"))
        parts.append(p.select("unit_id", "t", *keep, F.lit(name).alias("model"), "predicted_rul", "alarm"))
    return reduce(DataFrame.unionByName, parts)


def benchmark_rows(df: DataFrame, dataset: str, wanted: list[str] | None = None, grid: bool = False, rounds: int = fit.ROUNDS) -> DataFrame:
    """The result relation. df also has true_rul (null: use the ramp to failure_index), failure_index, prior_quality, equipment_type, is_run_to_failure.

    n_valid is the unit's number of rows.
    """
    actual = F.coalesce(F.col("true_rul"), life.ramp(F.col("failure_index")))
    facts = ("n", "failure_index", "actual_rul", "prior_quality", "equipment_type", "is_run_to_failure")
    d = model_tracks(df.withColumn("actual_rul", actual), wanted, grid, facts, rounds)
    keys = ["unit_id", "model", "n", "prior_quality", "equipment_type", "is_run_to_failure"]
    told = {k: c for k, c in (evaluation.rul_aggregates() | evaluation.detection_aggregates()).items() if k != "n_valid"}
    d = d.groupBy(*keys).agg(*[c.alias(k) for k, c in told.items()])
    order = ["dataset", "unit_id", "model", "prior_quality", "equipment_type", "is_run_to_failure", "n_valid", "rmse", "mae", "nasa_score", "mean_bias", "detection_lead_time", "false_alarm_rate", "detection_success"]
    return d.select("*", F.lit(dataset).alias("dataset"), F.col("n").alias("n_valid")).withColumn("unit_id", F.col("unit_id").cast("string")).select(order)


def full_benchmark(datasets: dict[str, DataFrame], **more) -> DataFrame:
    """All data sets' result rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [benchmark_rows(d, name, **more) for name, d in datasets.items()])


def run_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset", "model").agg(*[F.bround(F.avg(c), 2).alias(c) for c in ("rmse", "mae", "nasa_score")])
