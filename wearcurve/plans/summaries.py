"""Queries over result rows: the benchmark of tracked events, dealt to three data sets by unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcurve import functions as fn
from wearcurve.operators import summary
from wearcurve.operators.units import trajectory
from wearcurve.plans import scores
from wearcurve.plans.registry import ORACLES, query
from wearcurve.plans.views import EV, SU, events, supplies, table
from wearcurve.sources import datasets

_NAMES = ["ims", "xjtu_sy", "femto"]
_M = ["threshold_alarm", "static_curve", "pid_adaptive", "pid_regime"]


def result_rows(spark, d) -> DataFrame:
    r = scores.benchmark_rows(spark, d).withColumn("false_alarm_rate", F.round("false_alarm_rate", 6))
    u = F.col("unit_id").cast("long")
    return r.withColumn("dataset", F.element_at(F.array(*map(F.lit, _NAMES)), (u % 3 + 1).cast("int"))).withColumn("unit_id", F.concat("dataset", F.lit("/Bearing"), u % 3 + 1, F.lit("_"), "unit_id"))


_BENCH = ORACLES["benchmark_rows"]
_HEAD, _BODY = _BENCH[: _BENCH.index(" SELECT 'events' AS dataset")], _BENCH[_BENCH.index("SELECT 'events' AS dataset") :]
ROWS = f"{_HEAD}, r0 AS ({_BODY}), r1 AS (SELECT * REPLACE (['ims', 'xjtu_sy', 'femto'][unit_id::BIGINT % 3 + 1] AS dataset) FROM r0), res AS (SELECT * REPLACE (dataset || '/Bearing' || (unit_id::BIGINT % 3 + 1) || '_' || unit_id AS unit_id) FROM r1)"


@query("cross_dataset_table", f"{ROWS} SELECT dataset, model, min(equipment_type) AS equipment_type, min(prior_quality) AS prior_quality, count(DISTINCT unit_id) AS n_units, round(avg(rmse), 6) AS mean_rmse, round(stddev_samp(rmse), 6) AS std_rmse, round(avg(mae), 6) AS mean_mae, round(stddev_samp(mae), 6) AS std_mae, round(avg(detection_lead_time), 6) AS mean_lead_time, round(avg(detection_success::INT), 6) AS success_rate FROM res GROUP BY dataset, model")
def cross_dataset_table(spark, d):
    return summary.cross_dataset_table(result_rows(spark, d))


@query("prior_quality", f"{ROWS} SELECT prior_quality, round(avg(rmse), 6) AS mean_rmse, round(stddev_samp(rmse), 6) AS std_rmse, round(avg(mae), 6) AS mean_mae, count(DISTINCT unit_id) AS n_units FROM res WHERE model IN ('pid_adaptive', 'pid_regime') GROUP BY prior_quality")
def prior_quality(spark, d):
    return summary.prior_quality_comparison(result_rows(spark, d))


_TWO = "a AS (SELECT dataset, avg(mae) AS a FROM res WHERE model = 'pid_adaptive' AND dataset <> 'femto' GROUP BY dataset), b AS (SELECT dataset, avg(mae) AS b FROM res WHERE model = 'pid_regime' AND dataset <> 'ims' GROUP BY dataset)"
_GAIN = "round(a, 6) AS pid_adaptive, round(b, 6) AS pid_regime, round((a - b) / a * 100, 6) AS improvement_pct"


def _sides(spark, d):
    """Each controller lacks in one data set, so that the two joins differ."""
    return result_rows(spark, d).where("NOT (model = 'pid_adaptive' AND dataset = 'femto') AND NOT (model = 'pid_regime' AND dataset = 'ims')")


@query("regime_benefit_outer", f"{ROWS}, {_TWO} SELECT coalesce(a.dataset, b.dataset) AS dataset, {_GAIN} FROM a FULL JOIN b ON a.dataset = b.dataset")
def regime_benefit_outer(spark, d):
    return summary.regime_benefit(_sides(spark, d))


@query("regime_benefit_inner", f"{ROWS}, {_TWO} SELECT a.dataset AS dataset, {_GAIN} FROM a JOIN b ON a.dataset = b.dataset")
def regime_benefit_inner(spark, d):
    return summary.regime_benefit(_sides(spark, d), "inner")


def _half_even(x, digits):
    return f"round_even({x}, {digits})"


@query("run_summary", f"{ROWS} SELECT dataset, model, " + ", ".join(f"{_half_even(f'avg({c})', 2)} AS {c}" for c in ("rmse", "mae", "nasa_score")) + " FROM res GROUP BY dataset, model")
def run_summary(spark, d):
    from wearcurve.operators.runner import run_summary as summarise

    return summarise(result_rows(spark, d))


@query("model_summary", f"{ROWS} SELECT model, count(DISTINCT unit_id) AS n_units, round(avg(rmse), 6) AS mean_rmse, round(avg(mae), 6) AS mean_mae, round(avg(nasa_score), 4) AS mean_nasa, round(avg(mean_bias), 6) AS mean_bias, round(avg(detection_lead_time), 6) AS mean_lead_time FROM res GROUP BY model")
def model_summary(spark, d):
    return summary.model_summary(result_rows(spark, d)).withColumn("mean_nasa", F.round("mean_nasa", 4))


def _pivot_sql(metric, values=_M, column="model"):
    return ", ".join(f"round(avg({metric}) FILTER (WHERE {column} = '{v}'), 6) AS {v}" for v in values)


@query("rmse_pivot", f"{ROWS} SELECT unit_id, {_pivot_sql('rmse')} FROM res GROUP BY unit_id")
def rmse_pivot(spark, d):
    return summary.pivoted(result_rows(spark, d), "unit_id", "model", _M, "rmse")


@query("dataset_model_pivot", f"{ROWS} SELECT dataset, {_pivot_sql('detection_lead_time')} FROM res GROUP BY dataset")
def dataset_model_pivot(spark, d):
    return summary.pivoted(result_rows(spark, d), "dataset", "model", _M, "detection_lead_time")


@query("wide_metrics", f"{ROWS} SELECT unit_id, " + ", ".join(f"round(avg({m}) FILTER (WHERE model = '{v}'), 6) AS {v}_{m}" for v in ("pid_adaptive", "pid_regime") for m in ("rmse", "mae", "mean_bias")) + ", round((avg(rmse) FILTER (WHERE model = 'pid_adaptive') - avg(rmse) FILTER (WHERE model = 'pid_regime')) / avg(rmse) FILTER (WHERE model = 'pid_adaptive') * 100, 6) + 0e0 AS improvement_pct FROM res GROUP BY unit_id")
def wide_metrics(spark, d):
    w = summary.pivoted_many(result_rows(spark, d), "unit_id", "model", summary.PID, ["rmse", "mae", "mean_bias"])
    return w.withColumn("improvement_pct", fn.percent_change(F.col("pid_adaptive_rmse"), F.col("pid_regime_rmse")))


@query("multi_agg_median", f"{ROWS} SELECT model, " + ", ".join(f"round({f}({m}), 6) AS {m}_{k}" for m in ("rmse", "mae", "false_alarm_rate", "detection_lead_time") for k, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"))) + " FROM res GROUP BY model")
def multi_agg_median(spark, d):
    return summary.multi_stat(result_rows(spark, d), ["rmse", "mae", "false_alarm_rate", "detection_lead_time"])


@query("describe_by_class", f"{ROWS} SELECT equipment_type, count(rmse) AS \"count\", round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS std, round(min(rmse), 6) AS min, round(quantile_cont(rmse, 0.25), 6) AS q25, round(quantile_cont(rmse, 0.5), 6) AS q50, round(quantile_cont(rmse, 0.75), 6) AS q75, round(max(rmse), 6) AS max FROM res GROUP BY equipment_type")
def describe_by_class(spark, d):
    return summary.describe(result_rows(spark, d), "equipment_type", "rmse")


@query("zero_shot_gap", f"{ROWS}, g AS (SELECT dataset, avg(rmse) FILTER (WHERE model = 'pid_adaptive') AS z, avg(rmse) FILTER (WHERE model = 'static_curve') AS s FROM res GROUP BY dataset) SELECT dataset, round(z, 6) AS pid_adaptive, round(s, 6) AS static_curve, round_even((z - s) / s * 100, 1) AS gap_pct FROM g")
def zero_shot_gap(spark, d):
    return summary.zero_shot_gap(result_rows(spark, d), refit="static_curve")


@query("percentile_nearest_unit", f"WITH {EV}, l AS (SELECT unit_id, max(n) AS n FROM ev GROUP BY unit_id), p AS (SELECT unnest([quantile_cont(n, 0.1), quantile_cont(n, 0.35), quantile_cont(n, 0.65), quantile_cont(n, 0.9)]) AS target FROM l), k AS (SELECT target, unit_id, n, row_number() OVER (PARTITION BY target ORDER BY abs(n - target), unit_id) AS k FROM l, p) SELECT DISTINCT unit_id, n FROM k WHERE k = 1")
def percentile_nearest_unit(spark, d):
    return summary.percentile_units(table(spark, d, "events").groupBy(F.col("user_id").alias("unit_id")).agg(F.count("*").alias("n")), [0.1, 0.35, 0.65, 0.9])


@query("length_stats", f"WITH {EV}, l AS (SELECT unit_id, max(n) AS n FROM ev GROUP BY unit_id) SELECT CASE WHEN unit_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, min(n) AS min_n, median(n) AS median_n, max(n) AS max_n, count(*) AS n_units FROM l GROUP BY 1")
def length_stats(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("unit_id")).agg(F.count("*").alias("n"))
    return summary.length_stats(n.withColumn("split", F.when(F.col("unit_id") % 5 == 0, "test").otherwise("train")), ["split"])


_MAKERS = {"ims": "Rexnord", "xjtu_sy": "LDK"}
_MAKER_SQL = "CASE dataset WHEN 'ims' THEN 'Rexnord' WHEN 'xjtu_sy' THEN 'LDK' ELSE 'SKF' END"


@query("manufacturer_summary", f"{ROWS} SELECT {_MAKER_SQL} AS manufacturer, count(DISTINCT unit_id) AS n_units, round(avg(rmse), 6) AS mean_rmse, round(stddev_samp(rmse), 6) AS std_rmse, round(median(rmse), 6) AS median_rmse FROM res WHERE model IN ('pid_adaptive', 'pid_regime') GROUP BY 1")
def manufacturer_summary(spark, d):
    r = result_rows(spark, d).where(F.col("model").isin(summary.PID)).withColumn("manufacturer", fn.lookup(F.col("dataset"), _MAKERS, "SKF"))
    return r.groupBy("manufacturer").agg(F.count_distinct("unit_id").alias("n_units"), F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.median("rmse").alias("median_rmse"))


@query("condition_matrix", f"{ROWS} SELECT regexp_extract(unit_id, 'Bearing(\\d)_', 1) AS condition, round(avg(rmse), 6) AS mean_rmse, round(stddev_samp(rmse), 6) AS std_rmse, count(*) AS n, {_pivot_sql('rmse')} FROM res GROUP BY 1")
def condition_matrix(spark, d):
    r = result_rows(spark, d).withColumn("condition", F.regexp_extract("unit_id", r"Bearing(\d)_", 1))
    return r.groupBy("condition").agg(F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.count("*").alias("n"), *[F.avg(F.when(F.col("model") == m, F.col("rmse"))).alias(m) for m in _M])


@query("field_completeness", "SELECT field, n_present, n_rows, round(n_present / n_rows, 6) AS share FROM (SELECT count(*) AS n_rows, unnest(['quality', 'toxic', 'text']) AS field, unnest([count(quality), count(toxic), count(text)]) AS n_present FROM documents LEFT JOIN labels USING (doc_id))")
def field_completeness(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return summary.completeness(p, ["quality", "toxic", "text"])


@query("label_sort", f"{ROWS} SELECT dataset || ' / ' || model AS label, round(avg(detection_lead_time), 6) AS mean_lead_time FROM res WHERE detection_lead_time IS NOT NULL GROUP BY dataset, model")
def label_sort(spark, d):
    return summary.labelled_lead_times(result_rows(spark, d))


@query("published_comparison", f"{ROWS} SELECT model AS method, round(avg(rmse), 6) AS rmse, false AS needs_training FROM res WHERE model IN ('pid_adaptive', 'pid_regime') GROUP BY model UNION ALL VALUES ('LSTM', 16.14e0, true), ('CNN-LSTM', 12.83e0, true), ('Transformer', 11.87e0, true)")
def published_comparison(spark, d):
    return summary.published_comparison(result_rows(spark, d))


@query("prior_tier_dataset", f"{ROWS} SELECT dataset, prior_quality, round(avg(rmse), 6) AS mean_rmse, count(*) AS n FROM res GROUP BY dataset, prior_quality")
def prior_tier_dataset(spark, d):
    return result_rows(spark, d).groupBy("dataset", "prior_quality").agg(F.avg("rmse").alias("mean_rmse"), F.count("*").alias("n"))


@query("model_condition_summary", f"{ROWS} SELECT model, regexp_extract(unit_id, 'Bearing(\\d)_', 1) AS condition, count(DISTINCT unit_id) AS n_units, round(avg(rmse), 6) AS mean_rmse, round(avg(mae), 6) AS mean_mae, round(avg(nasa_score), 2) AS mean_nasa, round(avg(mean_bias), 6) AS mean_bias, round(avg(detection_lead_time), 6) AS mean_lead_time FROM res GROUP BY 1, 2")
def model_condition_summary(spark, d):
    r = result_rows(spark, d).withColumn("condition", F.regexp_extract("unit_id", r"Bearing(\d)_", 1))
    return summary.model_summary(r, ["model", "condition"]).withColumn("mean_nasa", F.round("mean_nasa", 2))


@query("side_by_side", f"{ROWS}, a AS (SELECT model, avg(rmse) AS ims FROM res WHERE dataset = 'ims' AND model <> 'pid_regime' GROUP BY model), b AS (SELECT model, avg(rmse) AS femto FROM res WHERE dataset = 'femto' AND model <> 'static_curve' GROUP BY model) SELECT coalesce(a.model, b.model) AS model, round(ims, 6) AS ims, round(femto, 6) AS femto FROM a FULL JOIN b ON a.model = b.model")
def side_by_side(spark, d):
    """Two data sets' means beside each other; a model that one of them lacks stays."""
    r = result_rows(spark, d).where("(dataset = 'ims' AND model <> 'pid_regime') OR (dataset = 'femto' AND model <> 'static_curve')")
    return summary.pivoted(r, "model", "dataset", ["ims", "femto"], "rmse")


@query("prior_tier_delta", f"{ROWS} SELECT dataset, round(avg(rmse) FILTER (WHERE prior_quality = 'exact_oem') - avg(rmse) FILTER (WHERE prior_quality = 'approximate_oem'), 6) + 0e0 AS delta_rmse FROM res GROUP BY dataset")
def prior_tier_delta(spark, d):
    q = lambda p: F.avg(F.when(F.col("prior_quality") == p, F.col("rmse")))
    return result_rows(spark, d).groupBy("dataset").agg((q("exact_oem") - q("approximate_oem")).alias("delta_rmse"))


@query("five_dataset_summary", f"{ROWS} SELECT dataset, min(prior_quality) AS prior, count(DISTINCT unit_id) AS n_units, {_pivot_sql('rmse')}, printf('%.1f%%', (avg(rmse) FILTER (WHERE model = 'static_curve') - avg(rmse) FILTER (WHERE model = 'pid_regime')) / avg(rmse) FILTER (WHERE model = 'static_curve') * 100) AS improvement FROM res GROUP BY dataset")
def five_dataset_summary(spark, d):
    m = lambda v: F.avg(F.when(F.col("model") == v, F.col("rmse")))
    return result_rows(spark, d).groupBy("dataset").agg(F.min("prior_quality").alias("prior"), F.count_distinct("unit_id").alias("n_units"), *[m(v).alias(v) for v in _M], F.format_string("%.1f%%", (m("static_curve") - m("pid_regime")) / m("static_curve") * 100).alias("improvement"))


_LIVES = [(ds, c, rpm, p, k, e) for ds, c, rpm, p, k, e in datasets.CONDITIONS]


@query("condition_lives", "SELECT dataset, condition::BIGINT AS condition, round(1e6 / (60e0 * rpm) * pow(c / p, e), 6) AS l10_hours FROM (VALUES " + ", ".join(f"('{ds}', {c}, {rpm}e0, {p}e0, {k}e0, {'10e0 / 3' if e > 3 else '3e0'})" for ds, c, rpm, p, k, e in _LIVES) + ") AS v(dataset, condition, rpm, p, c, e)")
def condition_lives(spark, d):
    return datasets.condition_lives(spark).select("dataset", "condition", "l10_hours")


@query("life_ratio", f"WITH {EV}, u AS (SELECT unit_id, max(n) / 6e0 AS hours FROM ev GROUP BY unit_id) SELECT unit_id, round(hours, 6) AS hours, round(hours / (1e6 / (60e0 * 2000e0) * pow(90.3e0 / 26.69e0, 10e0 / 3)) * 100, 6) AS pct_of_life FROM u")
def life_ratio(spark, d):
    from wearcurve.operators.rating import l10_hours

    u = table(spark, d, "events").groupBy(F.col("user_id").alias("unit_id")).agg((F.count("*") / 6.0).alias("hours"))
    return u.withColumn("pct_of_life", F.col("hours") / l10_hours(90.3, 26.69, 2000.0, 10.0 / 3.0) * 100)


@query("union_by_name", f"WITH {EV}, {SU} SELECT 'events' AS dataset, unit_id, t, value, NULL::DOUBLE AS quantity FROM ev UNION ALL SELECT 'supplies', unit_id, t, NULL, quantity FROM su")
def union_by_name(spark, d):
    e = events(spark, d).select(F.lit("events").alias("dataset"), "unit_id", "t", "value")
    return e.unionByName(supplies(spark, d).select(F.lit("supplies").alias("dataset"), "unit_id", "t", "quantity"), allowMissingColumns=True)


@query("membership_filter", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def membership_filter(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query("regex_key", "SELECT regexp_extract(p_type, '(\\w+)$', 1) AS material, regexp_extract(p_brand, '(\\d)', 1) AS maker, count(*) AS n FROM part GROUP BY 1, 2")
def regex_key(spark, d):
    return table(spark, d, "part").groupBy(F.regexp_extract("p_type", r"(\w+)$", 1).alias("material"), F.regexp_extract("p_brand", r"(\d)", 1).alias("maker")).agg(F.count("*").alias("n"))


@query("map_lookup", "SELECT s_suppkey, n_name, r_name, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'mid' ELSE 'other' END AS side FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def map_lookup(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select("s_suppkey", "n_name", "r_name", fn.lookup(F.col("r_name"), {"ASIA": "east", "EUROPE": "mid"}, "other").alias("side"))


@query("dedup_max_score", "SELECT o_custkey AS chunk_id, max(o_totalprice) AS score FROM orders GROUP BY 1")
def dedup_max_score(spark, d):
    from wearcurve.operators.retrieval import dedup_max

    return dedup_max(table(spark, d, "orders").select(F.col("o_custkey").alias("chunk_id"), F.col("o_totalprice").alias("score")))


@query("observation_append", f"WITH {EV} SELECT unit_id, count(*) + 1 AS n, round(avg(value), 6) AS mean_value FROM ev GROUP BY unit_id")
def observation_append(spark, d):
    from wearcurve.sources.writers import append_observation

    e = events(spark, d)
    more = e.where("t = n - 1").select("unit_id", (F.col("t") + 1).alias("t"))
    return append_observation(e.select("unit_id", "t", "value"), more).groupBy("unit_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query("prior_round_trip", f"WITH {EV} SELECT unit_id, round(max(n) * 2e0, 6) AS expected_life, count(*) AS curve_points, round(sum(t / 10e0), 6) AS curve_sum FROM ev GROUP BY unit_id")
def prior_round_trip(spark, d):
    from wearcurve.sources.writers import prior_from_json, prior_json

    e = trajectory(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    p = e.groupBy("unit_id").agg((F.max("n") * 2.0).alias("expected_life"), F.sort_array(F.collect_list(F.col("t") / 10.0)).alias("baseline_curve"))
    p = p.select("expected_life", "baseline_curve", F.lit(1.0).alias("threshold"), F.lit("cycles").alias("life_unit"), F.lit("events").alias("source"), F.lit("exact").alias("confidence"), F.create_map(F.lit("unit_id"), F.col("unit_id").cast("string")).alias("parameters"))
    back = prior_from_json(prior_json(p))
    return back.select(F.element_at("parameters", "unit_id").cast("long").alias("unit_id"), "expected_life", F.size("baseline_curve").alias("curve_points"), F.aggregate("baseline_curve", F.lit(0.0), lambda a, x: a + x).alias("curve_sum"))
