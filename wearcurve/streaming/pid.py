"""The step controller over a stream of readings, and its batch twin.

State of a unit is fixed in size (sums and short rings), so a stream may run for ever. Readings are applied in event-time order: a
micro-batch's own rows are sorted (readings of one time by their values), rows of the same time as the last applied one follow it, and rows that are older than it are left out (a
watermark upstream bounds how old they can be).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wearcurve.kernels.trackers import StepState, pid_step, pid_steps
from wearcurve.operators.units import per_unit, trajectory

STATE = "cumulative double, errors array<double>, previous double, accelerated boolean, volatilities array<double>, usual double, steps long, seen long, last_ts timestamp"
#: A total order of readings, up to equal ones.
ORDER = ["ts", "observed", "baseline", "threshold"]
OUTPUT = "unit_id long, ts timestamp, step long, adjusted double, predicted_rul double, regime string"


def _apply(unit: int, pdf: pd.DataFrame, s: StepState) -> pd.DataFrame:
    rows = []
    for ts, o, b, thr in zip(pdf["ts"], pdf["observed"], pdf["baseline"], pdf["threshold"], strict=True):
        adjusted, rul = pid_step(float(o), float(b), s, threshold=float(thr))
        rows.append((unit, ts, s.seen - 1, adjusted, rul, "accelerated" if s.accelerated else "normal"))
    return pd.DataFrame(rows, columns=["unit_id", "ts", "step", "adjusted", "predicted_rul", "regime"])


def stream(readings: DataFrame) -> DataFrame:
    """OUTPUT for a stream of unit_id, ts, observed, baseline, threshold."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.getOption
        s, last = (StepState(*held[:8]), held[8]) if held else (StepState(), None)
        pdf = pd.concat(list(batches)).sort_values(ORDER, kind="stable")
        if last is not None:
            pdf = pdf[pdf["ts"] >= pd.Timestamp(last)]
        if len(pdf):
            out = _apply(int(key[0]), pdf, s)
            state.update((*s.pack(), pdf["ts"].iloc[-1].to_pydatetime()))
            yield out

    return readings.select("unit_id", "ts", "observed", "baseline", "threshold").groupBy("unit_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def batch(readings: DataFrame) -> DataFrame:
    """The same rows from a table; all units of a block advance together."""

    def kernel(x: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
        return pid_steps(x["observed"], x["baseline"], x["threshold"])

    d = trajectory(readings, "unit_id", ORDER, ts="ts", observed="observed", baseline="baseline", threshold="threshold")
    d = per_unit(d, ["observed", "baseline", "threshold"], kernel, "adjusted double, predicted_rul double, accelerated boolean", keep=("ts",))
    return d.select("unit_id", "ts", F.col("t").alias("step"), "adjusted", "predicted_rul", F.when(F.col("accelerated"), "accelerated").otherwise("normal").alias("regime"))


def tick_aggregates(readings: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """unit_id, start, n, mean, max of each unit and window of event time; rows later than the watermark are dropped."""
    d = readings.withWatermark("ts", late).groupBy("unit_id", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.avg("observed").alias("mean"), F.max("observed").alias("max"))
    return d.select("unit_id", F.col("w.start").alias("start"), "n", "mean", "max")
