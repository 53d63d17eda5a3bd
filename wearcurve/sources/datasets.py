"""Fixed facts about the public data sets, as small tables.

Values are those that the data sets' publishers and bearing makers state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: dataset, equipment, unit of time, hours between rows, failed units only for these splits, prior quality
DATASETS = [
    ("ims", "roller bearing", "10 min", 1 / 6, "exact_oem"),
    ("xjtu_sy", "ball bearing", "1 min", 1 / 60, "exact_oem"),
    ("femto", "ball bearing", "10 s", 10 / 3600, "approximate_oem"),
    ("cwru", "ball bearing", "window", None, "exact_oem"),
    ("cmapss", "turbofan engine", "cycle", None, "fleet_average"),
    ("oxford_battery", "lithium-ion cell", "cycle", None, "approximate_oem"),
]
#: dataset, condition, rpm, load in kN, rating in kN, exponent
CONDITIONS = [("xjtu_sy", 1, 2100.0, 12.0, 12.0, 3.0), ("xjtu_sy", 2, 2250.0, 11.0, 12.0, 3.0), ("xjtu_sy", 3, 2400.0, 10.0, 12.0, 3.0), ("femto", 1, 1800.0, 4.0, 13.5, 3.0), ("femto", 2, 1650.0, 4.2, 13.5, 3.0), ("femto", 3, 1500.0, 5.0, 13.5, 3.0), ("ims", 1, 2000.0, 26.69, 90.3, 10.0 / 3.0)]
#: Health of which phase: see wearcurve.operators.life.phase.
ENGINE_CAP, BATTERY_END, BATTERY_NOMINAL_MAH = 125.0, 0.8, 740.0


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, "dataset string, equipment_type string, time_unit string, hours_per_row double, prior_quality string")


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, "dataset string, condition int, rpm double, p_kn double, c_kn double, exponent double")


def condition_lives(spark: SparkSession) -> DataFrame:
    """conditions + expected life in hours."""
    from wearcurve.operators.rating import l10_hours

    return conditions(spark).withColumn("l10_hours", l10_hours("c_kn", "p_kn", "rpm", F.col("exponent")))
