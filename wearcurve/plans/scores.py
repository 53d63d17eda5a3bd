"""Queries over controllers, models and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearcurve.operators import evaluation, models, runner, scaling, trackers
from wearcurve.plans.curves import _Z, DUE, ROUNDS, grid_fit, refined_fit
from wearcurve.plans.registry import query
from wearcurve.plans.views import EV, PID, TR, events, tracked
from wearcurve.streaming import pid as stream_pid


@query("pid_track", f"WITH RECURSIVE {PID} SELECT unit_id, t, round(adj, 6) AS adjusted, round(corr, 6) + 0e0 AS correction, round(cum_after, 6) + 0e0 AS cumulative, round(e, 6) + 0e0 AS error, round(pt, 6) + 0e0 AS p_term, round(it, 6) + 0e0 AS i_term, round(dt, 6) + 0e0 AS d_term, round(rul, 4) AS predicted_rul FROM pid")
def pid_track(spark, d):
    return trackers.pid_track(tracked(spark, d)).withColumn("predicted_rul", F.round("predicted_rul", 4))


@query("pid_final_state", f"WITH RECURSIVE {PID} SELECT unit_id, round(adj, 6) AS adjusted, round(cum_after, 6) + 0e0 AS cumulative, round(e, 6) + 0e0 AS error FROM pid WHERE t = n - 1")
def pid_final_state(spark, d):
    return trackers.pid_final_state(tracked(spark, d))


#: h: the last 15 errors; v: volatilities of the calibration; usual: their median, once it's over.
REGIME = TR + """, g0 AS (
    SELECT unit_id, t, n, thr, b AS adj, o - b AS e, o - b AS ep, [o - b] AS h, []::DOUBLE[] AS v, NULL::DOUBLE AS usual, 0e0 AS cum, false AS fast FROM tr WHERE t = 0
    UNION ALL
    SELECT unit_id, t, n, thr, adj, e, ep, h, CASE WHEN len(h) = 15 AND t < greatest(20, n // 4) THEN list_append(v, vol) ELSE v END, usual2, cum, CASE WHEN usual2 IS NULL OR len(h) < 15 THEN fast ELSE vol > 2 * usual2 END
    FROM (SELECT *, CASE WHEN usual IS NULL AND len(h) = 15 AND t >= greatest(20, n // 4) AND len(v) > 0 THEN greatest(1e-8, list_median(v)) ELSE usual END AS usual2 FROM (
      SELECT y.*, list_stddev_pop(y.h) AS vol FROM (
        SELECT x.unit_id, x.t, x.n, x.thr, x.b + p.cum2 AS adj, x.o - (x.b + p.cum2) AS e, p.e AS ep, list_append(p.h, x.o - (x.b + p.cum2))[-15:] AS h, p.v, p.usual, p.cum2 AS cum, p.fast
        FROM (SELECT *, cum + greatest(-0.05e0 * gm, least(0.05e0 * gm, 0.08e0 * gm * e + 0.02e0 * gm * list_avg(h[-10:]) + 0.03e0 * (e - ep))) AS cum2 FROM (SELECT *, CASE WHEN fast THEN 1.45e0 ELSE 1e0 END AS gm FROM g0)) p JOIN tr x ON x.unit_id = p.unit_id AND x.t = p.t + 1) y))),
  g1 AS (SELECT *, CASE WHEN fast THEN 1.45e0 ELSE 1e0 END AS gm FROM g0),
  g2 AS (SELECT *, greatest(-0.05e0 * gm, least(0.05e0 * gm, 0.08e0 * gm * e + 0.02e0 * gm * list_avg(h[-10:]) + 0.03e0 * (e - ep))) AS corr,
    CASE WHEN fast THEN least(t, 3) ELSE least(t, 8) END AS back, lag(adj, 3) OVER w AS l3, coalesce(lag(adj, 8) OVER w, first_value(adj) OVER w) AS l8 FROM g1 WINDOW w AS (PARTITION BY unit_id ORDER BY t)),
  reg AS (SELECT *, (adj + cum + corr - CASE WHEN fast THEN l3 ELSE l8 END) / back AS rate FROM g2),
  regime AS (SELECT *, CASE WHEN t < 5 THEN NULL WHEN rate > 1e-8 THEN greatest(0, (thr - (adj + corr)) / rate) ELSE n - t END AS rul FROM reg)"""


@query("pid_regime_track", f"WITH RECURSIVE {REGIME} SELECT unit_id, t, round(adj, 6) AS adjusted, round(cum + corr, 6) + 0e0 AS cumulative, round(e, 6) + 0e0 AS error, round(rul, 4) AS predicted_rul, CASE WHEN fast THEN 'accelerated' ELSE 'normal' END AS regime FROM regime")
def pid_regime_track(spark, d):
    return trackers.pid_regime_track(tracked(spark, d)).select("unit_id", "t", "adjusted", "cumulative", "error", F.round("predicted_rul", 4).alias("predicted_rul"), "regime")


#: usual, state and counter of the detector over the error series.
DETECT = PID + """, er AS (SELECT unit_id, t, n, e, CASE WHEN count(*) OVER w >= 15 THEN stddev_pop(e) OVER w END AS vol FROM pid WINDOW w AS (PARTITION BY unit_id ORDER BY t ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
  d0 AS (SELECT unit_id, t, vol, 0e0 AS usual, false AS fast, false AS changed, 0 AS k FROM er WHERE t = 0
    UNION ALL
    SELECT unit_id, t, vol, usual2, CASE WHEN flip THEN NOT fast ELSE fast END, flip, CASE WHEN flip THEN 0 ELSE k2 END FROM (
      SELECT *, vol IS NOT NULL AND k2 >= 5 AND (vol > 2 * usual2) <> fast AS flip FROM (
        SELECT x.unit_id, x.t, x.vol, p.fast, CASE WHEN x.vol IS NULL THEN p.usual WHEN x.t = 14 THEN greatest(x.vol, 1e-8) WHEN p.fast THEN p.usual ELSE 0.95e0 * p.usual + 0.05e0 * x.vol END AS usual2, p.k + CASE WHEN x.vol IS NULL THEN 0 ELSE 1 END AS k2
        FROM d0 p JOIN er x ON x.unit_id = p.unit_id AND x.t = p.t + 1)))"""


def _errors(spark, d):
    return trackers.pid_track(tracked(spark, d)).select("unit_id", "t", "error")


@query("regime_detect", f"WITH RECURSIVE {DETECT} SELECT unit_id, t, round(vol, 6) AS volatility, CASE WHEN fast THEN 'accelerated' ELSE 'normal' END AS regime, changed FROM d0")
def regime_detect(spark, d):
    return trackers.regime_detect(_errors(spark, d))


@query(
    "regime_runs",
    f"WITH RECURSIVE {DETECT}, i AS (SELECT unit_id, t, fast, CASE WHEN lag(fast) OVER (PARTITION BY unit_id ORDER BY t) = fast THEN 0 ELSE 1 END AS fresh FROM d0), "
    "j AS (SELECT *, sum(fresh) OVER (PARTITION BY unit_id ORDER BY t) - 1 AS run FROM i) SELECT unit_id, run::BIGINT AS run, any_value(CASE WHEN fast THEN 'accelerated' ELSE 'normal' END) AS regime, min(t) AS \"start\", max(t) AS \"end\" FROM j GROUP BY unit_id, run",
)
def regime_runs(spark, d):
    return trackers.regime_runs(trackers.regime_detect(_errors(spark, d)))


@query("warning_time", f"WITH RECURSIVE {DETECT} SELECT unit_id, min(t) FILTER (WHERE changed) AS first_change, max(t) - min(t) FILTER (WHERE changed) AS warning_steps FROM d0 GROUP BY unit_id")
def warning_time(spark, d):
    return trackers.warning_time(trackers.regime_detect(_errors(spark, d)))


_ERR = "CASE WHEN rul IS NOT NULL THEN rul - (n - 1 - t) END"
_PEN = "CASE WHEN d IS NOT NULL THEN least(1e6, CASE WHEN d < 0 THEN exp(least(-d / 13, 20e0)) - 1 ELSE exp(least(d / 10, 20e0)) - 1 END) END"
_METRICS = f"count(d) AS n_valid, round(sqrt(avg(d * d)), 4) AS rmse, round(avg(abs(d)), 4) AS mae, round(sum({_PEN}), 2) AS nasa_score, round(avg(d), 4) AS mean_bias"


def _told(df):
    return df.withColumns({c: F.round(c, 4) for c in ("rmse", "mae", "mean_bias")} | {"nasa_score": F.round("nasa_score", 2)})


def _scored(spark, d):
    t = tracked(spark, d).withColumn("actual_rul", (F.col("n") - 1 - F.col("t")).cast("double"))
    return trackers.pid_track(t, keep=("actual_rul",))


@query("pid_metrics", f"WITH RECURSIVE {PID}, m AS (SELECT unit_id, {_ERR} AS d FROM pid) SELECT unit_id, {_METRICS} FROM m GROUP BY unit_id")
def pid_metrics(spark, d):
    """The flagship: scaled trajectories, the controller's track, its remaining life against the actual one, scores of each unit."""
    return _told(evaluation.rul_metrics(_scored(spark, d), ["unit_id"]))


@query("rul_metrics", f"WITH {EV}, m AS (SELECT unit_id, value - (n - 1 - t) AS d FROM ev WHERE event_ok) SELECT unit_id, {_METRICS} FROM m GROUP BY unit_id".replace(" WHERE event_ok", ""))
def rul_metrics(spark, d):
    e = events(spark, d).select("unit_id", "t", F.col("value").alias("predicted_rul"), (F.col("n") - 1 - F.col("t")).cast("double").alias("actual_rul"))
    return _told(evaluation.rul_metrics(e, ["unit_id"]))


@query("nasa_score", f"WITH {EV}, m AS (SELECT t, value - (n - 1 - t) AS d FROM ev) SELECT t, round(sum({_PEN}), 3) AS nasa_score, count(*) AS n FROM m GROUP BY t")
def nasa_score(spark, d):
    e = events(spark, d).select("t", (F.col("value") - (F.col("n") - 1 - F.col("t"))).alias("d"))
    return e.groupBy("t").agg(F.round(F.sum(evaluation.nasa_penalty(F.col("d"))), 3).alias("nasa_score"), F.count("*").alias("n"))


_DETECTION = "n - 1 - min(t) FILTER (WHERE alarm > 0 AND t < n - 1) AS detection_lead_time, min(t) FILTER (WHERE alarm > 0 AND t < n - 1) IS NOT NULL AS detection_success, round(coalesce(avg(alarm) FILTER (WHERE t < n // 4), 0), 6) AS false_alarm_rate"


@query("detection_metrics", f"WITH {EV}, m AS (SELECT *, CASE WHEN value >= 60 THEN 1 ELSE 0 END AS alarm FROM ev) SELECT unit_id, {_DETECTION} FROM m GROUP BY unit_id, n")
def detection_metrics(spark, d):
    e = events(spark, d).withColumn("alarm", (F.col("value") >= 60).cast("int")).withColumn("failure_index", F.col("n") - 1)
    return evaluation.detection_metrics(e, ["unit_id"])


#: Tracks of the models that SQL can repeat.
MODELS = f"""{PID}, {REGIME.removeprefix(TR + ', ')}, zz AS (SELECT unit_id, t, n, o AS value FROM tr), {_Z.replace('FROM ev', 'FROM zz')}, {grid_fit('z', 'unit_id', '(t / (n + 0e0))')},
  cr AS (SELECT z.unit_id, z.t, z.n, a * (exp(b * z.t / z.n) - 1) AS f FROM z JOIN fit USING (unit_id)), x AS (SELECT unit_id, min(t) FILTER (WHERE f >= 1e0) AS x FROM cr GROUP BY unit_id),
  tracks AS (
    SELECT unit_id, t, n, 'threshold_alarm' AS model, NULL::DOUBLE AS rul, CASE WHEN o >= 1e0 THEN 1 ELSE 0 END AS alarm FROM tr
    UNION ALL SELECT *, CASE WHEN rul < 50 THEN 1 ELSE 0 END FROM (
      SELECT unit_id, t, n, 'static_curve', CASE WHEN x IS NULL THEN n - t + 0e0 ELSE greatest(0e0, x - t + 0e0) END AS rul FROM cr JOIN x USING (unit_id)
      UNION ALL SELECT unit_id, t, n, 'pid_adaptive', rul FROM pid UNION ALL SELECT unit_id, t, n, 'pid_regime', rul FROM regime)),
  scored AS (SELECT *, CASE WHEN rul IS NOT NULL THEN rul - (n - 1 - t) END AS d FROM tracks)"""
_SQL_MODELS = ["threshold_alarm", "static_curve", "pid_adaptive", "pid_regime"]


@query(
    "compare_models",
    f"WITH RECURSIVE {MODELS}, u AS (SELECT model, unit_id, n, min(t) FILTER (WHERE alarm > 0 AND t < n - 1) AS a FROM scored GROUP BY ALL) "
    f"SELECT model, {_METRICS}, round(avg(alarm) FILTER (WHERE t < n // 4), 4) AS false_alarm_rate FROM scored GROUP BY model",
)
def compare_models(spark, d):
    t = tracked(spark, d).withColumns({"failure_index": F.col("n") - 1, "actual_rul": (F.col("n") - 1 - F.col("t")).cast("double")})
    c = evaluation.compare_models(runner.model_tracks(t, _SQL_MODELS, grid=True, keep=("n", "failure_index", "actual_rul")))
    return _told(c).select("model", "n_valid", "rmse", "mae", "nasa_score", "mean_bias", F.round("false_alarm_rate", 4).alias("false_alarm_rate"))


def bench_units(spark, d):
    """Tracked events as benchmark units, with stand-ins for the facts about a unit."""
    t = tracked(spark, d)
    return t.select(
        "*", (F.col("n") - 1 - F.col("t")).cast("double").alias("true_rul"), F.when(F.col("unit_id") % 10 != 0, F.col("n") - 1).alias("failure_index"), F.when(F.col("unit_id") % 2 == 0, "exact_oem").otherwise("approximate_oem").alias("prior_quality"),
        F.when(F.col("unit_id") % 3 == 0, "roller").otherwise("ball").alias("equipment_type"), (F.col("unit_id") % 10 != 0).alias("is_run_to_failure"),
    )


_RESULT_SQL = (
    f"SELECT 'events' AS dataset, unit_id::VARCHAR AS unit_id, model, CASE WHEN unit_id % 2 = 0 THEN 'exact_oem' ELSE 'approximate_oem' END AS prior_quality, CASE WHEN unit_id % 3 = 0 THEN 'roller' ELSE 'ball' END AS equipment_type, unit_id % 10 <> 0 AS is_run_to_failure, "
    f"n AS n_valid, {_METRICS.replace('count(d) AS n_valid, ', '')}, CASE WHEN unit_id % 10 <> 0 THEN n - 1 - min(t) FILTER (WHERE alarm > 0 AND t < n - 1) END AS detection_lead_time, "
    "CASE WHEN unit_id % 10 <> 0 THEN round(coalesce(avg(alarm) FILTER (WHERE t < n // 4), 0), 6) END AS false_alarm_rate, CASE WHEN unit_id % 10 <> 0 THEN min(t) FILTER (WHERE alarm > 0 AND t < n - 1) IS NOT NULL END AS detection_success FROM scored GROUP BY unit_id, n, model"
)


@query("benchmark_rows", f"WITH RECURSIVE {MODELS} {_RESULT_SQL}")
def benchmark_rows(spark, d):
    return _told(runner.benchmark_rows(bench_units(spark, d), "events", _SQL_MODELS, grid=True))


#: Tracks of all five models, with refined fits.
ALL_MODELS = f"""{MODELS.split(', zz AS')[0]}, zz AS (SELECT unit_id, t, n, o AS value FROM tr), {_Z.replace('FROM ev', 'FROM zz')}, {refined_fit('z', 'unit_id', '(t / (n + 0e0))')},
  cr AS (SELECT z.unit_id, z.t, z.n, a * (exp(b * z.t / z.n) - 1) AS f FROM z JOIN rf USING (unit_id)), x AS (SELECT unit_id, min(t) FILTER (WHERE f >= 1e0) AS x FROM cr GROUP BY unit_id),
  due AS (SELECT unit_id, t AS ra FROM z WHERE n >= 50 AND {DUE}), win AS (SELECT d.unit_id, d.ra, (z.t - (d.ra - 50)) / 50e0 AS u, z.z FROM due d JOIN z ON z.unit_id = d.unit_id AND z.t BETWEEN d.ra - 50 AND d.ra), {refined_fit('win', 'unit_id, ra', 'u', 'w_')},
  rr AS (SELECT unit_id, t, n, last_value(CASE WHEN {DUE} THEN t END IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY t) AS ra FROM z WHERE n >= 50),
  cross_at AS (SELECT unit_id, ra, min(j) AS j FROM w_rf, (SELECT unnest(range(200)) AS j) WHERE a * (exp(b * (1 + 2e0 * j / 199)) - 1) >= 1e0 GROUP BY unit_id, ra),
  rolled AS (SELECT r.unit_id, r.t, r.n, 'rolling_refit', CASE WHEN c.j IS NULL THEN r.n - r.t + 0e0 ELSE floor(c.j * 25e0) END AS rul FROM rr r LEFT JOIN cross_at c ON c.unit_id = r.unit_id AND c.ra = r.ra),
  tracks AS{MODELS.split('tracks AS')[1].replace("UNION ALL SELECT unit_id, t, n, 'pid_adaptive'", "UNION ALL SELECT * FROM rolled UNION ALL SELECT unit_id, t, n, 'pid_adaptive'")}"""


@query("benchmark_all_models", f"WITH RECURSIVE {ALL_MODELS} {_RESULT_SQL}")
def benchmark_all_models(spark, d):
    """All five models with refined fits."""
    return _told(runner.benchmark_rows(bench_units(spark, d), "events", rounds=ROUNDS))


#: The step controller as a recursive query; h: the last 15 errors, v: the first 5 volatilities, since: tests since the last switch.
STEPS = """so AS (SELECT user_id AS unit_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS t, value AS o, 50e0 AS b, 100e0 AS thr FROM events),
  sx AS (
    SELECT unit_id, -1::BIGINT AS t, ts, o, thr, 0e0 AS e, 0e0 AS cum, []::DOUBLE[] AS h, []::DOUBLE[] AS v, 0 AS since, false AS fast, 0e0 AS adj FROM so WHERE t = 0
    UNION ALL
    SELECT unit_id, t, ts, o, thr, e, cum + greatest(-0.05e0 * g, least(0.05e0 * g, raw)), h, v, since, fast, b + cum + greatest(-0.05e0 * g, least(0.05e0 * g, raw))
    FROM (SELECT *, 0.08e0 * g * e + 0.02e0 * g * list_avg(h[-10:]) + 0.03e0 * g * (e - before) AS raw
      FROM (SELECT * REPLACE (fast <> flip AS fast, CASE WHEN flip THEN 0 ELSE since END AS since), CASE WHEN fast <> flip THEN 2.5e0 ELSE 1e0 END AS g
        FROM (SELECT *, len(v) = 5 AND since >= 5 AND (vol > 2 * greatest(1e-8, list_median(v))) <> fast AS flip
          FROM (SELECT * REPLACE (CASE WHEN len(h) = 15 AND len(v) < 5 THEN list_append(v, vol) ELSE v END AS v, CASE WHEN len(h) = 15 THEN since + 1 ELSE since END AS since)
            FROM (SELECT *, CASE WHEN len(h) = 15 THEN list_stddev_pop(h) END AS vol
              FROM (SELECT x.unit_id, x.t, x.ts, x.o, x.b, x.thr, x.o - (x.b + p.cum) AS e, p.e AS before, p.cum, list_append(p.h, x.o - (x.b + p.cum))[-15:] AS h, p.v, p.since, p.fast
                FROM sx p JOIN so x ON x.unit_id = p.unit_id AND x.t = p.t + 1)))))))"""


@query(
    "pid_stream_batch",
    f"WITH RECURSIVE {STEPS} SELECT unit_id, ts, t AS step, round(adj, 6) AS adjusted, round(CASE WHEN t >= 4 AND (h[-1] - h[-5]) / 4 > 1e-8 THEN greatest(0, (thr - o) / ((h[-1] - h[-5]) / 4)) END, 3) AS predicted_rul, "
    "CASE WHEN fast THEN 'accelerated' ELSE 'normal' END AS regime FROM sx WHERE t >= 0",
)
def pid_stream_batch(spark, d):
    """The batch twin of the streaming controller (tests hold the stream against it)."""
    h = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("unit_id"), "ts", F.col("value").alias("observed"), F.lit(50.0).alias("baseline"), F.lit(100.0).alias("threshold"))
    return stream_pid.batch(h).withColumn("predicted_rul", F.when(F.col("predicted_rul") < float("inf"), F.round("predicted_rul", 3)))


@query("healthy_alarm", f"WITH {EV}, h AS (SELECT *, avg(CASE WHEN t < greatest(1, n // 10) THEN value END) OVER (PARTITION BY unit_id) AS hm, stddev_pop(CASE WHEN t < greatest(1, n // 10) THEN value END) OVER (PARTITION BY unit_id) AS sd FROM ev) SELECT unit_id, min(t) FILTER (WHERE value >= CASE WHEN hm + 5 * sd > hm THEN hm + 5 * sd ELSE hm + 1 END) AS first_alarm FROM h GROUP BY unit_id")
def healthy_alarm(spark, d):
    h = scaling.healthy_threshold(events(spark, d), "value")
    return h.groupBy("unit_id").agg(models.first_index(F.col("value") >= F.col("threshold")).alias("first_alarm"))
