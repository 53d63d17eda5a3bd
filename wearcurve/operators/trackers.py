"""Controllers and regime detection over trajectories (unit_id, t, observed, baseline, threshold)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearcurve.kernels import trackers as k
from wearcurve.operators.units import in_order, per_unit

_TRACK = "adjusted double, correction double, cumulative double, error double, p_term double, i_term double, d_term double, predicted_rul double"


def pid_track(df: DataFrame, params: k.PIDParams = k.PIDParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    def kernel(x: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
        return k.pid(x["observed"], x["baseline"], n, x["threshold"], params)

    return per_unit(df, ["observed", "baseline", "threshold"], kernel, _TRACK, ("threshold",), keep)


def pid_regime_track(df: DataFrame, params: k.PIDParams = k.PIDParams(), vol_window: int = 15, vol_threshold: float = 2.0, gain: float = 2.5, keep: tuple[str, ...] = ()) -> DataFrame:
    def kernel(x: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
        made = k.pid_regime(x["observed"], x["baseline"], n, x["threshold"], params, vol_window, vol_threshold, gain)
        return made | {"regime": np.where(made["accelerated"], "accelerated", "normal")}

    return per_unit(df, ["observed", "baseline", "threshold"], kernel, _TRACK + ", regime string", ("threshold",), keep)


def pid_final_state(df: DataFrame, params: k.PIDParams = k.PIDParams()) -> DataFrame:
    """unit_id, adjusted, cumulative, error of the last row: the whole recurrence as one fold over the unit's ordered rows, in SQL only."""
    p = params
    fold = f"""aggregate(rows, named_struct('c', 0D, 'e', cast(array() AS array<double>), 'a', cast(NULL AS double)),
        (s, r) -> transform(array(r.observed - (r.baseline + s.c)), err -> transform(array(slice(concat(array(err), s.e), 1, {p.integral_window})), h -> named_struct(
            'c', s.c + greatest({-p.clip}D, least({p.clip}D, {p.kp}D * err + {p.ki}D * (aggregate(h, 0D, (x, y) -> x + y) / size(h)) + if(size(h) > 1, {p.kd}D * (err - coalesce(try_element_at(h, 2), 0D)), 0D))),
            'e', h, 'a', r.baseline + s.c))[0])[0])"""
    rows = df.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("t", "observed", "baseline"))).alias("rows"))
    return rows.select("unit_id", F.expr(fold).alias("s")).select("unit_id", F.col("s.a").alias("adjusted"), F.col("s.c").alias("cumulative"), F.col("s.e")[0].alias("error"))


def regime_detect(df: DataFrame, vol_window: int = 15, multiplier: float = 2.0, least: int = 5) -> DataFrame:
    """unit_id, t, volatility, regime, changed of an error series (unit_id, t, error)."""

    def kernel(x: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
        made = k.regimes(x["error"], n, vol_window, multiplier, least)
        return made | {"regime": np.where(made["accelerated"], "accelerated", "normal")}

    return per_unit(df, ["error"], kernel, "volatility double, regime string, changed boolean")


def regime_runs(df: DataFrame, label: str = "regime") -> DataFrame:
    """unit_id, run, regime, start, end (inclusive): islands of equal labels."""
    d = df.withColumn("_new", F.when(F.lag(label).over(in_order()).eqNullSafe(F.col(label)), 0).otherwise(1))
    d = d.withColumn("run", F.sum("_new").over(in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return d.groupBy("unit_id", "run").agg(F.first(label).alias("regime"), F.min("t").alias("start"), F.max("t").alias("end"))


def warning_time(df: DataFrame) -> DataFrame:
    """unit_id, first_change, warning_steps: rows between the first switch and the unit's end."""
    d = df.groupBy("unit_id").agg(F.min(F.when(F.col("changed"), F.col("t"))).alias("first_change"), F.max("t").alias("_last"))
    return d.select("unit_id", "first_change", (F.col("_last") - F.col("first_change")).alias("warning_steps"))
