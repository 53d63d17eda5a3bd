"""Signal features: frames, moments and band energies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearcurve.kernels import spectra
from wearcurve.operators.units import in_order

SLICE_ROWS = 100_000


def moments(x: str) -> dict[str, Column]:
    """Aggregates: rms, peak, crest factor, peak to peak, kurtosis (Pearson) and skewness; the last two are null for constant values."""
    v = F.col(x)
    rms, peak = F.sqrt(F.avg(v * v)), F.max(F.abs(v))
    flat = F.max(v) == F.min(v)
    return {
        "rms": rms,
        "peak": peak,
        "crest_factor": F.when(rms > 0, peak / rms).otherwise(F.lit(0.0)),
        "peak_to_peak": F.max(v) - F.min(v),
        "kurtosis": F.when(~flat, F.kurtosis(v) + 3),
        "skewness": F.when(~flat, F.skewness(v)),
    }


def unit_features(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("unit_id").agg(*[c.alias(k) for k, c in moments(value).items()])


def two_axis(df: DataFrame, horizontal: str, vertical: str) -> DataFrame:
    h, v = moments(horizontal), moments(vertical)
    d = df.groupBy("unit_id").agg(
        *[h[k].alias(f"h_{k}") for k in ("rms", "kurtosis", "crest_factor", "peak_to_peak", "skewness")], *[v[k].alias(f"v_{k}") for k in ("rms", "kurtosis")]
    )
    return d.withColumn("rms_combined", F.sqrt(F.col("h_rms") ** 2 + F.col("v_rms") ** 2))


def signals(df: DataFrame, value: str) -> DataFrame:
    """unit_id, samples: each unit's values by t, as one array."""
    pairs = F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v"))))
    return df.groupBy("unit_id").agg(F.transform(pairs, lambda p: p["v"]).alias("samples"))


def framed_rows(df: DataFrame, size: int, hop: int) -> DataFrame:
    """df + frame: a row for each frame that a sample is in, over samples that are rows (no unit has to fit into one array). Incomplete tails are dropped."""
    last = F.floor((F.col("n") - size) / hop)
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - size + 1) / hop))
    high = F.least(last, F.floor(F.col("t") / hop))
    return df.where((F.col("n") >= size)).withColumn("frame", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))


def frames(signal: DataFrame, size: int, hop: int, sr: float) -> DataFrame:
    """unit_id, frame, time_s (of the frame's middle), samples: overlapping slices of arrays; incomplete tails are dropped."""
    starts = F.when(F.size("samples") >= size, F.sequence(F.lit(0), F.size("samples") - size, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    d = signal.select("unit_id", "samples", F.posexplode(starts).alias("frame", "start"))
    return d.select("unit_id", F.col("frame").cast("long").alias("frame"), ((F.col("start") + size / 2) / sr).alias("time_s"), F.slice("samples", F.col("start") + 1, size).alias("samples"))


def framed_features(df: DataFrame, value: str, size: int, hop: int, sr: float) -> DataFrame:
    """unit_id, frame, time_s and moments of every frame."""
    d = framed_rows(df, size, hop).groupBy("unit_id", "frame").agg(*[c.alias(k) for k, c in moments(value).items()])
    return d.withColumn("time_s", (F.col("frame") * hop + size / 2) / F.lit(sr))


def band_energies(framed: DataFrame, sr: float, bands: dict[str, float], half_width: float, harmonics: int = 1, scaled: bool = True, broadband: bool = False) -> DataFrame:
    """unit_id, frame, a column for each band, and the rest of the energy as broadband (below 0 where bands overlap). One transform a frame."""
    names, centres = list(bands), np.array(list(bands.values()), float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["unit_id", "frame"]].copy()
            if len(pdf):
                x = np.stack(pdf["samples"].to_numpy())
                e = spectra.band_energies(x, sr, centres, half_width, harmonics, scaled)
                for k, name in enumerate(names):
                    out[name] = e[:, k]
                if broadband:
                    out["broadband"] = spectra.total_energy(x, scaled) - e.sum(axis=1)
                yield out

    more = [*names, *["broadband"] * broadband]
    return framed.select("unit_id", "frame", "samples").mapInPandas(run, "unit_id long, frame long, " + ", ".join(f"{c} double" for c in more))


TIME_FEATURES = ["rms", "peak", "crest_factor", "peak_to_peak", "kurtosis", "skewness"]


def snapshot_features(recordings: DataFrame, keys: list[str], sr: float = 1.0, bands: dict[str, float] | None = None, half_width: float = 5.0, harmonics: int = 3) -> DataFrame:
    """keys, time features, and <band>_energy over harmonics (unscaled), of every recording (samples). One pass over the arrays."""
    names, centres = list(bands or {}), np.array(list((bands or {}).values()), float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf["samples"]:
                f = spectra.time_features(x)
                e = spectra.band_energies(np.asarray(x, float)[None, :], sr, centres, half_width, harmonics, False)[0] if names else []
                rows.append([*[f[k] for k in TIME_FEATURES], *e])
            yield pd.concat([pdf[keys], pd.DataFrame(rows, columns=[*TIME_FEATURES, *[f"{n}_energy" for n in names]], index=pdf.index, dtype=float)], axis=1)

    d = recordings.where(F.size("samples") > 0).select(*keys, "samples")
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name in keys], *[f"{c} double" for c in [*TIME_FEATURES, *[f"{n}_energy" for n in names]]]])
    made = d.mapInPandas(run, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("kurtosis", "skewness")})


def severity_concat(df: DataFrame, phase: str, order: list[str], ranks: list[str], duration: str) -> DataFrame:
    """Phases one behind another, in the order of ranks: df + time_offset (durations of all earlier phases) + time_index. Phases that aren't there add nothing.

    order begins with a number. A phase is cut into slices of it of about SLICE_ROWS rows; the running number is the row's number in its slice plus the
    sizes of all earlier slices, so no window spans a phase.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(phase)).cast("int")
    d = df.withColumn("_rank", rank).where("_rank > 0")
    span = d.agg(F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi"), F.count("*").alias("n")).first()
    slices = max(1, span.n // SLICE_ROWS)
    width = max(((span.hi or 0) - (span.lo or 0)) / slices, 1e-300)
    d = d.withColumn("_slice", F.least(F.floor((F.col(order[0]) - F.lit(span.lo)) / F.lit(width)), F.lit(slices - 1)))
    sizes = d.groupBy("_rank", "_slice").agg(F.count("*").alias("_n"), F.sum(duration).alias("_d"))
    w = Window.orderBy("_rank", "_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    phases = Window.orderBy("_rank").rangeBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_rank", "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.coalesce(F.sum("_d").over(phases), F.lit(0.0)).alias("time_offset"))
    own = F.row_number().over(Window.partitionBy("_rank", "_slice").orderBy(*order)) - 1
    return d.join(before, ["_rank", "_slice"]).withColumn("time_index", (own + F.col("_before")).cast("long")).drop("_rank", "_slice", "_before")


def trailing_volatility(value: str, rows: int = 15) -> Column:
    """Population deviation of the last rows; null before there are as many."""
    w = in_order().rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) >= rows, F.stddev_pop(value).over(w))
