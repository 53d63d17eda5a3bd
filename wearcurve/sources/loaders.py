"""Trajectories and priors of the public data sets, from their readers.

Every loader gives observations: unit_id, t, n, features, value (the primary feature), hours, true_rul (null where unknown), failure_index,
and the prior's columns: expected_life, threshold, baseline, prior_quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearcurve.operators import features, life, rating, scaling
from wearcurve.sources import datasets, readers

#: Sampling rates in Hz; files of the four phases of the severity series, and the variable's name by the number of the file.
RATES = {"ims": 20_480.0, "xjtu_sy": 25_600.0, "femto": 25_600.0, "cwru": 12_000.0}
PHASES = {"normal": "healthy", "0.007": "mild", "0.014": "moderate", "0.021": "severe"}
SENSORS = ["s_2", "s_3", "s_4", "s_7", "s_8", "s_9", "s_11", "s_12", "s_13", "s_14", "s_15", "s_17", "s_20", "s_21"]


def mat_key(number: int) -> str:
    return f"X{number:03d}_DE_time"


def dataset_info(spark: SparkSession, name: str) -> DataFrame:
    return datasets.datasets(spark).where(F.col("dataset") == name)


def positions(df: DataFrame, order: str, unit: str = "unit_id") -> DataFrame:
    w = Window.partitionBy(unit)
    return df.withColumn("t", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn("n", F.count("*").over(w))


def oem_prior(obs: DataFrame, expected_life: Column, quality: str, value: str = "value", shape: str = "exponential") -> DataFrame:
    """obs + expected_life, threshold, baseline (between healthy mean and threshold) and prior_quality."""
    d = scaling.healthy_threshold(obs, value).withColumn("baseline", scaling.scaled_baseline(rating.baseline(shape=shape)))
    return d.withColumns({"expected_life": expected_life, "prior_quality": F.lit(quality)})


def _bearings(recordings: DataFrame, dataset: str, hours_per_row: float, life_hours: Column, quality: str, bands: dict[str, float] | None, failed: Column) -> DataFrame:
    f = features.snapshot_features(recordings, ["unit_id", "snapshot"], RATES[dataset], bands)
    d = positions(f, "snapshot").withColumns({"value": F.col("kurtosis"), "hours": F.col("t") * hours_per_row})
    d = d.withColumn("failure_index", F.when(failed, F.col("n") - 1)).withColumn("true_rul", F.when(failed, life.hours_left()))
    return oem_prior(d, life_hours, quality)


def _defects(spark: SparkSession, geometry: str, rpm: float) -> dict[str, float]:
    cols = rating.defect_frequencies(rpm, *rating.GEOMETRIES[geometry])
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def ims(spark: SparkSession, folder: str, first_test: bool, failed: list[str]) -> DataFrame:
    """failed: the bearings (bearing_1 ...) that failed at the end of the test."""
    r = readers.ims(spark, folder, first_test)
    return _bearings(r, "ims", 1 / 6, rating.l10_hours(90.3, 26.69, 2000.0, 10 / 3), "exact_oem", _defects(spark, "ims", 2000.0), F.col("unit_id").isin(failed))


def xjtu(spark: SparkSession, folder: str, unit: str, condition: int) -> DataFrame:
    _, _, rpm, p, c, e = next(x for x in datasets.CONDITIONS if x[:2] == ("xjtu_sy", condition))
    return _bearings(readers.xjtu(spark, folder, unit), "xjtu_sy", 1 / 60, rating.l10_hours(c, p, rpm, e), "exact_oem", _defects(spark, "xjtu_sy", rpm), F.lit(True))


def femto(spark: SparkSession, folder: str, unit: str, condition: int, train: bool = True) -> DataFrame:
    """Both axes; only units of the training split are known to have failed. Loads are given in newtons by the publisher."""
    _, _, rpm, p, c, e = next(x for x in datasets.CONDITIONS if x[:2] == ("femto", condition))
    r = readers.femto(spark, folder, unit)
    h = features.snapshot_features(r.withColumn("samples", F.col("horizontal")), ["unit_id", "snapshot"])
    v = features.snapshot_features(r.withColumn("samples", F.col("vertical")), ["unit_id", "snapshot"]).select("unit_id", "snapshot", F.col("rms").alias("v_rms"), F.col("kurtosis").alias("v_kurtosis"))
    d = h.join(v, ["unit_id", "snapshot"]).withColumn("rms_combined", F.sqrt(F.col("rms") ** 2 + F.col("v_rms") ** 2))
    d = positions(d, "snapshot").withColumns({"value": F.col("kurtosis"), "hours": F.col("t") * (10 / 3600)})
    d = d.withColumn("failure_index", F.when(F.lit(train), F.col("n") - 1)).withColumn("true_rul", F.when(F.lit(train), life.hours_left()))
    return oem_prior(d, rating.l10_hours(c, p, rpm, e), "approximate_oem")


def cwru(spark: SparkSession, files: dict[str, str], size: int = 2400, hop: int = 1200) -> DataFrame:
    """files: of normal, 0.007, 0.014 and 0.021 (any may lack or be missing): their frames one behind another, with running time and phase."""
    from pyspark.errors import AnalysisException

    sr, out = RATES["cwru"], None
    for rank, (severity, phase) in enumerate(PHASES.items()):
        if severity in files:
            try:
                s = readers.mat_signals(spark, files[severity]).select(F.lit(rank).alias("rank"), F.lit(phase).alias("phase"), "samples")
            except AnalysisException:
                continue
            out = s if out is None else out.unionByName(s)
    if out is None:
        raise FileNotFoundError(f"none of {sorted(files.values())}")
    lengths = out.select("rank", (F.size("samples") / sr).alias("seconds"))
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # at most four rows
    offsets = lengths.select("rank", F.coalesce(F.sum("seconds").over(w), F.lit(0.0)).alias("offset"))
    f = features.frames(out.withColumn("unit_id", F.col("rank").cast("long")), size, hop, sr).join(out.select(F.col("rank").cast("long").alias("unit_id"), "phase").join(offsets.select(F.col("rank").cast("long").alias("unit_id"), "offset"), "unit_id"), "unit_id")
    f = f.select(F.lit("cwru").alias("unit"), (F.col("unit_id") * 1_000_000 + F.col("frame")).alias("order"), "phase", (F.col("time_s") + F.col("offset")).alias("seconds"), "samples")
    m = features.snapshot_features(f, ["unit", "order", "phase", "seconds"]).withColumnRenamed("unit", "unit_id")
    d = positions(m, "order").drop("order").withColumns({"value": F.col("kurtosis"), "hours": F.col("seconds") / 3600})
    d = d.withColumn("failure_index", F.col("n") - 1).withColumn("true_rul", life.linear())
    return oem_prior(d, rating.l10_hours(14.8, rating.bearing_load_kn(2.0, 1797.0), 1797.0), "exact_oem")


def engines(spark: SparkSession, train_path: str, test_path: str, lives_path: str) -> DataFrame:
    """Both splits (split: train or test): the smoothed mean of the training-scaled sensors, against the fleet's average."""
    train = readers.engines(spark, train_path).withColumns({"split": F.lit("train"), "last_rul": F.lit(None).cast("double")})
    test = readers.engine_tests(readers.engines(spark, test_path), readers.engine_lives(spark, lives_path)).withColumn("split", F.lit("test"))
    both = train.unionByName(test).select(F.concat("split", F.lit("_"), "unit_nr").alias("unit_id"), "split", "time_cycles", "last_rul", *SENSORS)
    z = scaling.train_normalised(both, SENSORS, F.col("split") == "train")
    d = positions(z.withColumn("raw", scaling.row_mean(SENSORS)), "time_cycles").withColumn("value", scaling.smooth("raw"))
    fleet = scaling.fleet_prior(d.where("split = 'train'"), "value")
    d = d.withColumn("failure_index", F.when(F.col("split") == "train", F.col("n") - 1))
    d = d.withColumn("true_rul", F.when(F.col("split") == "train", life.capped()).otherwise(life.test_offset(F.col("last_rul"))))
    curve = fleet.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "prior"))), lambda x: x["prior"]).alias("curve"))  # as long as the longest unit
    d = d.crossJoin(F.broadcast(curve)).withColumn("baseline", rating.aligned("curve"))
    return d.select("unit_id", "t", "n", "split", "value", F.col("time_cycles").cast("double").alias("hours"), "true_rul", "failure_index", "baseline", F.lit(0.0).alias("threshold"), F.size("curve").cast("double").alias("expected_life"), F.lit("fleet_average").alias("prior_quality"))


def batteries(spark: SparkSession, path: str) -> DataFrame:
    """Health of cells against a linear fade; the failure is the first cycle below 80 %."""
    b = readers.battery_capacity(spark, path, datasets.BATTERY_NOMINAL_MAH)
    d = positions(b.withColumn("unit_id", F.col("cell")), "cycle").withColumn("value", F.col("soh"))
    d = life.end_of_life(d, "value", datasets.BATTERY_END).withColumns({"phase": life.phase("value"), "baseline": rating.linear_fade(), "threshold": F.lit(datasets.BATTERY_END), "hours": F.col("cycle").cast("double"), "expected_life": F.lit(500.0), "prior_quality": F.lit("approximate_oem")})
    return d.withColumn("deviation", F.col("value") - F.col("baseline"))
