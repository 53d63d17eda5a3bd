"""Baseline models over trajectories: threshold alarms, static curve fits, rolling refits."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearcurve.kernels import fit
from wearcurve.operators.units import by_unit, first_index, in_order, per_unit

LEVELS = {"warning": 0.5, "alert": 1.0, "danger": 2.0}


def alarm_level(levels: dict[str, float]) -> float:
    return levels.get("alert", levels.get("warning", 1.0))


def threshold_alarm(df: DataFrame, value: str, levels: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """unit_id, t, alarm (0 or 1), keep."""
    return df.select("unit_id", "t", *keep, (F.col(value) >= alarm_level(levels or LEVELS)).cast("int").alias("alarm"))


def first_crossings(df: DataFrame, value: str, levels: dict[str, float] | None = None) -> DataFrame:
    """unit_id, first_<level> of each level, first_alarm; null where it's never reached."""
    levels = levels or LEVELS
    return df.groupBy("unit_id").agg(*[first_index(F.col(value) >= x).alias(f"first_{k}") for k, x in levels.items()], first_index(F.col(value) >= alarm_level(levels)).alias("first_alarm"))


def _loop(one, n: np.ndarray, names: tuple[str, ...], shape: tuple[int, int]) -> dict[str, np.ndarray]:
    out = {k: np.full(shape, np.nan) for k in names}
    for u, m in enumerate(n):
        for k, v in zip(names, one(u, int(m)), strict=True):
            out[k][u, :m] = v
    return out


def static_curve(df: DataFrame, value: str, fit_window: int | None = None, grid: bool = False, keep: tuple[str, ...] = (), rounds: int = fit.ROUNDS) -> DataFrame:
    """unit_id, t, fitted, predicted_rul, a, b. df has threshold. grid: b only from the kernel's grid; rounds: golden sections around its best point."""
    fitter = fit.fit_grid if grid else partial(fit.fit, rounds=rounds)

    def kernel(x: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
        return _loop(lambda u, m: fit.static(x[value][u, :m], fit_window, float(x["threshold"][u]), fitter), n, ("fitted", "predicted_rul", "a", "b"), x[value].shape)

    return per_unit(df, [value, "threshold"], kernel, "fitted double, predicted_rul double, a double, b double", ("threshold",), keep)


def rolling_refit(df: DataFrame, value: str, window: int = 50, every: int = 10, grid: bool = False, keep: tuple[str, ...] = (), rounds: int = fit.ROUNDS) -> DataFrame:
    """unit_id, t, fitted, predicted_rul, refit (1 where the curve was fitted anew)."""
    fitter = fit.fit_grid if grid else partial(fit.fit, rounds=rounds)

    def kernel(x: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
        return _loop(lambda u, m: fit.rolling(x[value][u, :m], window, every, float(x["threshold"][u]), fitter), n, ("fitted", "predicted_rul", "refit"), x[value].shape)

    return per_unit(df, [value, "threshold"], kernel, "fitted double, predicted_rul double, refit double", ("threshold",), keep)


def static_coefficients(df: DataFrame, value: str) -> DataFrame:
    """unit_id, a, b of the grid fit."""
    return static_curve(df.withColumn("threshold", F.lit(1.0)), value, grid=True).where("t = 0").select("unit_id", "a", "b")


def refit_points(df: DataFrame, window: int = 50, every: int = 10) -> DataFrame:
    """df + refit_at: the last refit at or before the row (null before the first)."""
    due = (F.col("t") >= window) & ((F.col("t") % every == 0) | (F.col("t") == window))
    return df.withColumn("refit_at", F.last(F.when(due, F.col("t")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
