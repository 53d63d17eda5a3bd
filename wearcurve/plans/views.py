"""The library's conceptual tables over the driver's tables, as DataFrames and as SQL of the same rows.

Units are users of `events` (by ts, event_id) or suppliers of `lineitem` (by shipdate and keys). A unit fails at its last row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcurve.operators import rating, scaling
from wearcurve.operators.units import trajectory


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Added before rounding: means of few-digit numbers lie exactly between two results, where the last bit would decide.
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to 6 decimals (no negative zero), integers as long."""
    cols = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        cols.append((F.round(c + F.lit(NUDGE), digits) + F.lit(0.0) if kind == "double" else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(f.name))
    return df.select(cols)


def events(spark: SparkSession, d: str) -> DataFrame:
    return trajectory(table(spark, d, "events"), "user_id", ["ts", "event_id"], value="value")


def supplies(spark: SparkSession, d: str) -> DataFrame:
    return trajectory(table(spark, d, "lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], quantity="l_quantity", price="l_extendedprice", discount="l_discount", tax="l_tax")


def tracked(spark: SparkSession, d: str) -> DataFrame:
    """Events scaled to 0..1 within the unit, against the exponential curve, with threshold 1."""
    return events(spark, d).select("unit_id", "t", "n", scaling.minmax("value").alias("observed"), rating.baseline().alias("baseline"), F.lit(1.0).alias("threshold"))


EV = "ev AS (SELECT user_id AS unit_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n, value FROM events)"
SU = """su AS (SELECT l_suppkey AS unit_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS t,
    count(*) OVER (PARTITION BY l_suppkey) AS n, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""
EXP_BASE = "CASE WHEN n > 1 THEN (exp(3e0 * t / (n - 1)) - 1) / (exp(3e0) - 1) ELSE 0e0 END"
TR = EV + f""", tr AS (SELECT unit_id, t, n, (value - min(value) OVER (PARTITION BY unit_id)) / CASE WHEN max(value) OVER (PARTITION BY unit_id) - min(value) OVER (PARTITION BY unit_id) < 1e-8 THEN 1e0
    ELSE max(value) OVER (PARTITION BY unit_id) - min(value) OVER (PARTITION BY unit_id) END AS o, {EXP_BASE} AS b, 1e0 AS thr FROM ev)"""
#: The controller's recurrence as a recursive query: h holds the last 10 errors.
PID = TR + """, st AS (
    SELECT unit_id, t, n, thr, b AS adj, o - b AS e, o - b AS ep, [o - b] AS h, 0e0 AS cum FROM tr WHERE t = 0
    UNION ALL
    SELECT x.unit_id, x.t, x.n, x.thr, x.b + p.cum2, x.o - (x.b + p.cum2), p.e, list_append(p.h, x.o - (x.b + p.cum2))[-10:], p.cum2
    FROM (SELECT *, cum + greatest(-0.05e0, least(0.05e0, 0.08e0 * e + 0.02e0 * list_avg(h) + 0.03e0 * (e - ep))) AS cum2 FROM st) p JOIN tr x ON x.unit_id = p.unit_id AND x.t = p.t + 1),
  c AS (SELECT *, 0.08e0 * e AS pt, 0.02e0 * list_avg(h) AS it, 0.03e0 * (e - ep) AS dt, greatest(-0.05e0, least(0.05e0, 0.08e0 * e + 0.02e0 * list_avg(h) + 0.03e0 * (e - ep))) AS corr,
    CASE WHEN t >= 5 THEN lag(adj, 5) OVER (PARTITION BY unit_id ORDER BY t) ELSE first_value(adj) OVER (PARTITION BY unit_id ORDER BY t) END AS past FROM st),
  pid AS (SELECT *, cum + corr AS cum_after, CASE WHEN t < 2 THEN NULL WHEN (adj + cum + corr - past) / least(t, 5) > 1e-8 THEN greatest(0, (thr - (adj + corr)) / ((adj + cum + corr - past) / least(t, 5))) ELSE n - t END AS rul FROM c)"""
