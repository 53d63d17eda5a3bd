"""Queries over trajectories: ratings, baselines, lives, normalisation and features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wearcurve import functions as fn
from wearcurve.operators import evaluation, features, life, models, rating, scaling
from wearcurve.operators.units import in_order, trailing
from wearcurve.plans.registry import query
from wearcurve.plans.views import EV, SU, events, supplies, table

_RPM = "(1000 + p_size * 20)"


@query("l10_life", f"SELECT p_partkey, round((1e6 / (60e0 * {_RPM})) * pow(p_retailprice / (100e0 + p_size), 3e0), 6) AS l10_hours, round((1e6 / (60e0 * {_RPM})) * pow(p_retailprice / (100e0 + p_size), 10e0 / 3e0), 6) AS l10_roller_hours FROM part")
def l10_life(spark, d):
    rpm, load = (F.lit(1000) + F.col("p_size") * 20).cast("double"), F.lit(100.0) + F.col("p_size")
    return table(spark, d, "part").select("p_partkey", rating.l10_hours("p_retailprice", load, rpm).alias("l10_hours"), rating.l10_hours("p_retailprice", load, rpm, 10.0 / 3.0).alias("l10_roller_hours"))


@query("bearing_load", f"SELECT p_partkey, round((2e0 * 9.81e0 * 0.5e0 + 0.05e0 * (p_size * 745.7e0 / (2 * pi() * {_RPM} / 60e0))) / 1000e0, 6) AS load_kn FROM part")
def bearing_load(spark, d):
    return table(spark, d, "part").select("p_partkey", rating.bearing_load_kn(F.col("p_size").cast("double"), (F.lit(1000) + F.col("p_size") * 20).cast("double")).alias("load_kn"))


def _defect_sql(n, d, p, a):
    r = f"({d}e0 / {p}e0 * cos(radians({a}e0)))"
    f = f"({_RPM} / 60e0)"
    return f"round({n} * 0.5e0 * (1 - {r}) * {f}, 6) AS bpfo, round({n} * 0.5e0 * (1 + {r}) * {f}, 6) AS bpfi, round({p}e0 / (2 * {d}e0) * (1 - {r} * {r}) * {f}, 6) AS bsf, round(0.5e0 * (1 - {r}) * {f}, 6) AS ftf"


@query("defect_freqs", " UNION ALL ".join(f"SELECT '{k}' AS geometry, p_partkey, {_defect_sql(*g)} FROM part" for k, g in rating.GEOMETRIES.items()))
def defect_freqs(spark, d):
    out = None
    for k, g in rating.GEOMETRIES.items():
        cols = rating.defect_frequencies((F.lit(1000) + F.col("p_size") * 20).cast("double"), *g)
        p = table(spark, d, "part").select(F.lit(k).alias("geometry"), "p_partkey", *[c.alias(n) for n, c in cols.items()])
        out = p if out is None else out.unionByName(p)
    return out


_U = "CASE WHEN n > 1 THEN t / (n - 1e0) ELSE 0e0 END"


@query("baseline_linear", f"WITH {EV} SELECT unit_id, t, round({_U}, 6) AS baseline, round(500e0 * ({_U}), 6) AS hours FROM ev")
def baseline_linear(spark, d):
    return events(spark, d).select("unit_id", "t", rating.baseline(shape="linear").alias("baseline"), rating.time_axis_hours(500.0).alias("hours"))


@query("baseline_exp", f"WITH {EV} SELECT unit_id, t, round((exp(3e0 * ({_U})) - 1) / (exp(3e0) - 1), 6) AS baseline FROM ev")
def baseline_exp(spark, d):
    return events(spark, d).select("unit_id", "t", rating.baseline().alias("baseline"))


@query("linear_fade", f"WITH {EV} SELECT unit_id, t, round(greatest(0, least(1, 1 - 0.2e0 * t / 500e0)), 6) AS soh FROM ev")
def linear_fade(spark, d):
    return events(spark, d).select("unit_id", "t", rating.linear_fade().alias("soh"))


@query("true_rul_ramp", f"WITH {EV} SELECT unit_id, t, greatest(0e0, (n - 1) - t + 0e0) AS ramp, round((n - 1 - t) / 6e0, 6) AS hours_left, round(CASE WHEN n > 1 THEN n * (1 - t / (n - 1e0)) ELSE n END, 6) AS even FROM ev")
def true_rul_ramp(spark, d):
    e = events(spark, d).withColumn("hours", F.col("t") / F.lit(6.0))
    return e.select("unit_id", "t", life.ramp(F.col("n") - 1).alias("ramp"), life.hours_left().alias("hours_left"), life.linear().alias("even"))


@query("true_rul_capped", f"WITH {SU} SELECT unit_id, t, least(n - 1 - t + 0e0, 125e0) AS rul FROM su")
def true_rul_capped(spark, d):
    return supplies(spark, d).select("unit_id", "t", life.capped().alias("rul"))


@query("rul_test_offset", f"WITH {SU} SELECT unit_id, t, greatest(0e0, least(125e0, (unit_id % 50) + (n - 1 - t) + 0e0)) AS rul FROM su")
def rul_test_offset(spark, d):
    return supplies(spark, d).select("unit_id", "t", life.test_offset(F.col("unit_id") % 50).alias("rul"))


_SOH = "(1 - t / (n * 2e0) - discount)"


@query("eol_index", f"WITH {SU}, h AS (SELECT *, {_SOH} AS soh FROM su), f AS (SELECT *, min(CASE WHEN soh < 0.8e0 THEN t END) OVER (PARTITION BY unit_id) AS failure_index FROM h) SELECT unit_id, t, failure_index, CASE WHEN failure_index IS NOT NULL THEN greatest(0e0, failure_index - t + 0e0) END AS true_rul, CASE WHEN soh > 0.85e0 THEN 'linear' WHEN soh >= 0.75e0 THEN 'knee' ELSE 'rapid' END AS phase FROM f")
def eol_index(spark, d):
    s = supplies(spark, d).withColumn("soh", 1 - F.col("t") / (F.col("n") * F.lit(2.0)) - F.col("discount"))
    return life.end_of_life(s, "soh").select("unit_id", "t", "failure_index", "true_rul", life.phase("soh").alias("phase"))


@query("soh_deviation_quarters", f"WITH {SU} SELECT unit_id, round(avg(CASE WHEN t < n // 4 THEN {_SOH} - greatest(0, least(1, 1 - 0.2e0 * t / 500e0)) END), 6) AS first_quarter, round(avg(CASE WHEN t >= 3 * n // 4 THEN {_SOH} - greatest(0, least(1, 1 - 0.2e0 * t / 500e0)) END), 6) AS last_quarter FROM su GROUP BY unit_id")
def soh_deviation_quarters(spark, d):
    s = supplies(spark, d).withColumn("soh", 1 - F.col("t") / (F.col("n") * F.lit(2.0)) - F.col("discount")).withColumn("expected", rating.linear_fade())
    return life.deviation_quarters(s, "soh", "expected")


@query("minmax_norm", f"WITH {SU} SELECT unit_id, t, round((price - min(price) OVER w) / CASE WHEN max(price) OVER w - min(price) OVER w < 1e-8 THEN 1e0 ELSE max(price) OVER w - min(price) OVER w END, 6) AS value FROM su WINDOW w AS (PARTITION BY unit_id)")
def minmax_norm(spark, d):
    return supplies(spark, d).select("unit_id", "t", scaling.minmax("price").alias("value"))


_S = ["quantity", "price", "discount", "tax"]


@query(
    "train_norm_health_index",
    f"WITH {SU}, r AS (SELECT " + ", ".join(f"min({s}) FILTER (WHERE unit_id % 5 <> 0) AS lo_{s}, max({s}) FILTER (WHERE unit_id % 5 <> 0) AS hi_{s}" for s in _S) + " FROM su), "
    "z AS (SELECT unit_id, t, " + ", ".join(f"({s} - lo_{s}) / CASE WHEN hi_{s} = lo_{s} THEN 1e-8 ELSE hi_{s} - lo_{s} END AS {s}" for s in _S) + " FROM su, r), "
    f"h AS (SELECT unit_id, t, ({' + '.join(_S)}) / 4 AS hi FROM z) SELECT unit_id, t, round(hi, 6) AS health_index, round(avg(hi) OVER (PARTITION BY unit_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth FROM h",
)
def train_norm_health_index(spark, d):
    z = scaling.train_normalised(supplies(spark, d), _S, F.col("unit_id") % 5 != 0)
    h = z.select("unit_id", "t", scaling.row_mean(_S).alias("health_index"))
    return h.withColumn("smooth", scaling.smooth("health_index"))


_HT = EV + """, h AS (SELECT *, avg(CASE WHEN t < greatest(1, n // 10) THEN value END) OVER (PARTITION BY unit_id) AS hm, stddev_pop(CASE WHEN t < greatest(1, n // 10) THEN value END) OVER (PARTITION BY unit_id) AS sd FROM ev),
  ht AS (SELECT unit_id, t, n, value, hm, CASE WHEN hm + 5 * sd > hm THEN hm + 5 * sd ELSE hm + 1 END AS thr FROM h)"""


@query("healthy_threshold", f"WITH {_HT} SELECT unit_id, round(any_value(hm), 6) AS healthy_mean, round(any_value(thr), 6) AS threshold FROM ht GROUP BY unit_id")
def healthy_threshold(spark, d):
    h = scaling.healthy_threshold(events(spark, d), "value")
    return h.where("t = 0").select("unit_id", "healthy_mean", "threshold")


@query("scaled_baseline", f"WITH {_HT} SELECT unit_id, t, round(hm + (exp(3e0 * ({_U})) - 1) / (exp(3e0) - 1) * (thr - hm), 6) AS baseline FROM ht")
def scaled_baseline(spark, d):
    h = scaling.healthy_threshold(events(spark, d), "value")
    return h.select("unit_id", "t", scaling.scaled_baseline(rating.baseline()).alias("baseline"))


@query(
    "fleet_prior",
    f"WITH {EV}, m AS (SELECT max(n) AS m FROM ev), f AS (SELECT unit_id, n, min(value) FILTER (WHERE t = 0) AS first FROM ev GROUP BY unit_id, n), p AS (SELECT unit_id, first, n, unnest(range(m)) AS back FROM f, m) "
    "SELECT (SELECT m FROM m) - 1 - p.back AS t, p.back AS back, round(avg(coalesce(e.value, p.first)), 6) AS prior FROM p LEFT JOIN ev e ON e.unit_id = p.unit_id AND e.n - 1 - e.t = p.back GROUP BY p.back",
)
def fleet_prior(spark, d):
    return scaling.fleet_prior(events(spark, d), "value")


@query("prior_alignment", f"WITH {EV}, c AS (SELECT list_transform(range(60), lambda k: k / 59e0) AS curve) SELECT unit_id, t, round(curve[least(t + 1, 60)], 6) AS baseline FROM ev, c")
def prior_alignment(spark, d):
    e = events(spark, d).withColumn("curve", F.array(*[F.lit(k / 59) for k in range(60)]))
    return e.select("unit_id", "t", rating.aligned("curve").alias("baseline"))



def _features_sql(src, key, x, prefix="", names=("rms", "peak", "crest_factor", "peak_to_peak", "kurtosis", "skewness")):
    """Moments written out: of the deviations from the group's mean."""
    e = {
        "rms": f"sqrt(avg({x} * {x}))", "peak": f"max(abs({x}))", "crest_factor": f"CASE WHEN sqrt(avg({x} * {x})) > 0 THEN max(abs({x})) / sqrt(avg({x} * {x})) ELSE 0e0 END", "peak_to_peak": f"max({x}) - min({x})",
        "kurtosis": f"CASE WHEN max({x}) > min({x}) THEN avg(pow({x} - m_{x}, 4)) / pow(avg(pow({x} - m_{x}, 2)), 2) END",
        "skewness": f"CASE WHEN max({x}) > min({x}) THEN avg(pow({x} - m_{x}, 3)) / pow(avg(pow({x} - m_{x}, 2)), 1.5e0) END",
    }
    return ", ".join(f"round({e[n]}, 6) AS {prefix}{n}" for n in names)


@query("time_features", f"WITH {SU}, x AS (SELECT *, avg(price) OVER (PARTITION BY unit_id) AS m_price FROM su) SELECT unit_id, {_features_sql('x', 'unit_id', 'price')} FROM x GROUP BY unit_id")
def time_features(spark, d):
    return features.unit_features(supplies(spark, d), "price")


@query(
    "two_axis_features",
    f"WITH {SU}, x AS (SELECT *, avg(quantity) OVER (PARTITION BY unit_id) AS m_quantity, avg(price) OVER (PARTITION BY unit_id) AS m_price FROM su) SELECT unit_id, "
    + _features_sql("x", "", "quantity", "h_", ("rms", "kurtosis", "crest_factor", "peak_to_peak", "skewness")) + ", " + _features_sql("x", "", "price", "v_", ("rms", "kurtosis"))
    + ", round(sqrt(avg(quantity * quantity) + avg(price * price)), 6) AS rms_combined FROM x GROUP BY unit_id",
)
def two_axis_features(spark, d):
    return features.two_axis(supplies(spark, d), "quantity", "price")


_W, _HOP, _SR = 64, 32, 64.0
_FR = SU + f", fr AS (SELECT s.unit_id, k.k AS frame, s.t - k.k * {_HOP} AS i, s.quantity AS x FROM su s, (SELECT unnest(range(100)) AS k) k WHERE k.k * {_HOP} + {_W} <= s.n AND s.t BETWEEN k.k * {_HOP} AND k.k * {_HOP} + {_W} - 1)"


@query("framed_features", f"WITH {_FR}, x AS (SELECT *, avg(x) OVER (PARTITION BY unit_id, frame) AS m_x FROM fr) SELECT unit_id, frame, round((frame * {_HOP} + {_W} / 2e0) / {_SR}, 6) AS time_s, {_features_sql('', '', 'x')} FROM x GROUP BY unit_id, frame")
def framed_features(spark, d):
    return features.framed_features(supplies(spark, d), "quantity", _W, _HOP, _SR)


def _framed(spark, d):
    return features.frames(features.signals(supplies(spark, d), "quantity"), _W, _HOP, _SR)


_DFT = _FR + f""", ft AS (SELECT unit_id, frame, k.k AS bin, pow(sum(x * cos(2 * pi() * i * k.k / {_W})), 2) + pow(sum(x * sin(2 * pi() * i * k.k / {_W})), 2) AS p
    FROM fr, (SELECT unnest(range({_W // 2 + 1})) AS k) k GROUP BY unit_id, frame, k.k)"""
_BANDS = {"bpfo": 6.5, "bpfi": 9.5, "bsf": 4.2, "ftf": 0.4}


def _band_sql(centre, half, scale, harmonics=1, digits=6):
    return "round(" + " + ".join(f"coalesce(sum(p) FILTER (WHERE abs(bin * {_SR} / {_W} - {h * centre}e0) <= {half}e0), 0)" for h in range(1, harmonics + 1)).join("()") + f" / {scale}, {digits})"


@query("band_energy", f"WITH {_DFT} SELECT unit_id, frame, " + ", ".join(f"{_band_sql(c, 1.5, f'{_W * _W}e0')} AS {k}" for k, c in _BANDS.items()) + " FROM ft GROUP BY unit_id, frame")
def band_energy(spark, d):
    return features.band_energies(_framed(spark, d), _SR, _BANDS, 1.5)


@query("harmonic_energy", f"WITH {_DFT} SELECT unit_id, frame, " + ", ".join(f"{_band_sql(c, 1.0, '1e0', 3, 3)} AS {k}_energy" for k, c in _BANDS.items()) + " FROM ft GROUP BY unit_id, frame")
def harmonic_energy(spark, d):
    e = features.band_energies(_framed(spark, d), _SR, _BANDS, 1.0, 3, False)
    return e.select("unit_id", "frame", *[F.round(k, 3).alias(f"{k}_energy") for k in _BANDS])


@query("broadband", f"WITH {_DFT} SELECT unit_id, frame, round((sum(p) - " + " - ".join(f"coalesce(sum(p) FILTER (WHERE abs(bin * {_SR} / {_W} - {c}e0) <= 1.5e0), 0)" for c in _BANDS.values()) + f") / {_W * _W}e0, 6) AS broadband FROM ft GROUP BY unit_id, frame")
def broadband(spark, d):
    return features.band_energies(_framed(spark, d), _SR, _BANDS, 1.5, broadband=True).select("unit_id", "frame", "broadband")


_PHASES = ["view", "click", "add_to_cart", "purchase", "signup"]


@query(
    "severity_concat",
    "WITH r AS (SELECT event_id, event_type, value, CASE event_type " + " ".join(f"WHEN '{p}' THEN {k + 1}" for k, p in enumerate(_PHASES)) + " END AS rk FROM events), s AS (SELECT rk, count(*) AS c, sum(value) AS v FROM r WHERE rk IS NOT NULL GROUP BY rk) "
    "SELECT event_id, event_type AS phase, row_number() OVER (ORDER BY rk, event_id) - 1 AS time_index, round(coalesce((SELECT sum(v) FROM s WHERE s.rk < r.rk), 0), 3) AS time_offset FROM r WHERE rk IS NOT NULL",
)
def severity_concat(spark, d):
    e = features.severity_concat(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", ["event_id"], _PHASES, "value")
    return e.select("event_id", F.col("event_type").alias("phase"), "time_index", F.round("time_offset", 3).alias("time_offset"))


@query("trailing_volatility", f"WITH {EV} SELECT unit_id, t, round(CASE WHEN count(*) OVER w >= 15 THEN stddev_pop(value) OVER w END, 6) AS volatility FROM ev WINDOW w AS (PARTITION BY unit_id ORDER BY t ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)")
def trailing_volatility(spark, d):
    return events(spark, d).select("unit_id", "t", features.trailing_volatility("value").alias("volatility"))


@query("integral_window", f"WITH {EV} SELECT unit_id, t, round(avg(value) OVER (PARTITION BY unit_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS i_mean, round(coalesce(value - lag(value) OVER (PARTITION BY unit_id ORDER BY t), 0), 6) AS d_step FROM ev")
def integral_window(spark, d):
    return events(spark, d).select("unit_id", "t", F.avg("value").over(trailing(10)).alias("i_mean"), F.coalesce(F.col("value") - F.lag("value").over(in_order()), F.lit(0.0)).alias("d_step"))


@query("lag_rate", f"WITH {EV} SELECT unit_id, t, round((value - lag(value, 5) OVER w) / 5, 6) AS rate5, round((value - lag(value, 3) OVER w) / 3, 6) AS rate3, round((value - lag(value, 8) OVER w) / 8, 6) AS rate8 FROM ev WINDOW w AS (PARTITION BY unit_id ORDER BY t)")
def lag_rate(spark, d):
    return events(spark, d).select("unit_id", "t", *[((F.col("value") - F.lag("value", k).over(in_order())) / k).alias(f"rate{k}") for k in (5, 3, 8)])


_LEVELS = {"warning": 20.0, "alert": 40.0, "danger": 48.0}


@query("threshold_alarm", f"WITH {SU} SELECT unit_id, t, CASE WHEN quantity >= 40 THEN 1::BIGINT ELSE 0 END AS alarm FROM su")
def threshold_alarm(spark, d):
    return models.threshold_alarm(supplies(spark, d), "quantity", _LEVELS)


@query("first_crossings", f"WITH {SU} SELECT unit_id, " + ", ".join(f"min(CASE WHEN quantity >= {v} THEN t END) AS first_{k}" for k, v in _LEVELS.items()) + ", min(CASE WHEN quantity >= 40 THEN t END) AS first_alarm FROM su GROUP BY unit_id")
def first_crossings(spark, d):
    return models.first_crossings(supplies(spark, d), "quantity", _LEVELS)


@query("clip_finite", "SELECT event_id, CASE WHEN isnan(v) THEN 0.05e0 ELSE round(greatest(-0.05e0, least(0.05e0, v)), 6) END AS clipped, CASE WHEN isnan(v) OR isinf(v) THEN 0::BIGINT ELSE 1 END AS finite FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'infinity'::DOUBLE ELSE (value - 50) / 500 END AS v FROM events)")
def clip_finite(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(math.nan)).when(F.col("event_id") % 11 == 0, F.lit(math.inf)).otherwise((F.col("value") - 50) / 500).alias("v"))
    return e.select("event_id", fn.clip(F.col("v"), F.lit(-0.05), F.lit(0.05)).alias("clipped"), evaluation.finite("v").cast("int").alias("finite"))


_GRID = "(SELECT k * 0.05e0 AS b FROM (SELECT unnest(range(1, 201)) AS k)) g"


def grid_fit(src: str, key: str, t: str, p: str = "") -> str:
    """CTEs <p>fit(key, a, b) of the grid fit over src(key, t-expression, z)."""
    return f"""{p}s AS (SELECT {key}, b, sum(z * (exp(b * {t}) - 1)) AS zg, sum(pow(exp(b * {t}) - 1, 2)) AS gg, sum(z * z) AS zz FROM {src}, {_GRID} GROUP BY {key}, b),
    {p}q AS (SELECT *, greatest(1e-6, least(10e0, zg / gg)) AS a FROM {p}s), {p}fit AS (SELECT {key}, a, b FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(zz - 2 * a * zg + a * a * gg, 9), b) AS k FROM {p}q) WHERE k = 1)"""


#: Sections that the twins make: errors at both points still differ by far more than the last bits of their sums, so both sides take the same halves.
ROUNDS, _GOLD = 14, "((sqrt(5e0) - 1) / 2)"


def refined_fit(src: str, key: str, t: str, p: str = "") -> str:
    """CTEs <p>rf(key, a, b): the grid fit, refined by golden sections (a recursive query)."""
    sums = lambda b, n: f"sum(z * (exp({b} * {t}) - 1)) AS zg{n}, sum(pow(exp({b} * {t}) - 1, 2)) AS gg{n}"
    best = lambda n: f"greatest(1e-6, least(10e0, zg{n} / gg{n}))"
    return f"""{grid_fit(src, key, t, p)},
  {p}gs AS (SELECT {key}, 0 AS r, greatest(1e-4, b - 0.05e0) AS low, least(10e0, b + 0.05e0) AS high FROM {p}fit UNION ALL
    SELECT {key}, r + 1, CASE WHEN e1 <= e2 THEN low ELSE x1 END, CASE WHEN e1 <= e2 THEN x2 ELSE high END FROM (
      SELECT *, a1 * a1 * gg1 - 2 * a1 * zg1 AS e1, a2 * a2 * gg2 - 2 * a2 * zg2 AS e2 FROM (SELECT *, {best(1)} AS a1, {best(2)} AS a2 FROM (
        SELECT {key}, r, low, high, x1, x2, {sums('x1', 1)}, {sums('x2', 2)} FROM (SELECT *, high - {_GOLD} * (high - low) AS x1, low + {_GOLD} * (high - low) AS x2 FROM {p}gs WHERE r < {ROUNDS}) JOIN {src} USING ({key}) GROUP BY ALL)))),
  {p}rf AS (SELECT {key}, b, {best('')} AS a FROM (SELECT {key}, b, {sums('b', '')} FROM (SELECT {key}, (low + high) / 2 AS b FROM {p}gs WHERE r = {ROUNDS}) JOIN {src} USING ({key}) GROUP BY {key}, b))"""


_Z = "z AS (SELECT unit_id, t, n, (value - min(value) OVER w) / CASE WHEN max(value) OVER w - min(value) OVER w < 1e-8 THEN 1e0 ELSE max(value) OVER w - min(value) OVER w END AS z, min(value) OVER w AS lo, max(value) OVER w AS hi FROM ev WINDOW w AS (PARTITION BY unit_id))"


@query("static_curve_grid", f"WITH {EV}, {_Z}, {grid_fit('z', 'unit_id', '(t / (n + 0e0))')} SELECT unit_id, round(a, 6) AS a, round(b, 6) AS b FROM fit")
def static_curve_grid(spark, d):
    return models.static_coefficients(events(spark, d), "value")


_STATIC_RUL = "CASE WHEN x.x IS NULL THEN z.n - z.t + 0e0 ELSE greatest(0e0, x.x - z.t + 0e0) END"
STATIC = f"""{EV}, {_Z}, {grid_fit('z', 'unit_id', '(t / (n + 0e0))')},
  cr AS (SELECT z.unit_id, z.t, z.n, z.lo, z.hi, a, b, a * (exp(b * z.t / z.n) - 1) AS f FROM z JOIN fit USING (unit_id)),
  x AS (SELECT unit_id, min(t) FILTER (WHERE f * (hi - lo) + lo >= 0.5e0 * (hi - lo) + lo) AS x FROM cr GROUP BY unit_id)"""


@query("static_curve", f"WITH {STATIC} SELECT z.unit_id, z.t, round(z.f * (z.hi - z.lo) + z.lo, 6) AS fitted, {_STATIC_RUL} AS predicted_rul FROM cr z JOIN x USING (unit_id)")
def static_curve(spark, d):
    """The kernel with the grid's fit, threshold 0.5."""
    return models.static_curve(events(spark, d).withColumn("threshold", F.lit(0.5)), "value", grid=True).select("unit_id", "t", "fitted", "predicted_rul")


REFINED = f"""{EV}, {_Z}, {refined_fit('z', 'unit_id', '(t / (n + 0e0))')},
  cr AS (SELECT z.unit_id, z.t, z.n, z.lo, z.hi, a * (exp(b * z.t / z.n) - 1) AS f FROM z JOIN rf USING (unit_id)),
  x AS (SELECT unit_id, min(t) FILTER (WHERE f * (hi - lo) + lo >= 0.5e0 * (hi - lo) + lo) AS x FROM cr GROUP BY unit_id)"""


@query("static_curve_refined", f"WITH RECURSIVE {REFINED} SELECT z.unit_id, z.t, round(z.f * (z.hi - z.lo) + z.lo, 6) AS fitted, {_STATIC_RUL} AS predicted_rul FROM cr z JOIN x USING (unit_id)")
def static_curve_refined(spark, d):
    """The grid's fit, refined by golden sections."""
    return models.static_curve(events(spark, d).withColumn("threshold", F.lit(0.5)), "value", rounds=ROUNDS).select("unit_id", "t", "fitted", "predicted_rul")


_RZ = _Z.replace("value", "price").replace("FROM ev", "FROM su")
DUE = "(t >= 50 AND (t % 10 = 0 OR t = 50))"
ROLLING = f"""{SU}, {_RZ}, due AS (SELECT unit_id, t AS ra FROM z WHERE {DUE}), win AS (SELECT d.unit_id, d.ra, (z.t - (d.ra - 50)) / 50e0 AS u, z.z FROM due d JOIN z ON z.unit_id = d.unit_id AND z.t BETWEEN d.ra - 50 AND d.ra),
  {grid_fit('win', 'unit_id, ra', 'u')},
  rr AS (SELECT z.*, last_value(CASE WHEN {DUE} THEN t END IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY t) AS ra FROM z),
  ahead AS (SELECT j, 1 + 2e0 * j / 199 AS u FROM (SELECT unnest(range(200)) AS j)),
  cross_at AS (SELECT unit_id, ra, min(j) AS j FROM fit, ahead WHERE a * (exp(b * u) - 1) >= 0.9e0 GROUP BY unit_id, ra)"""


@query(
    "rolling_refit",
    f"WITH {ROLLING} SELECT r.unit_id, r.t, round(CASE WHEN r.ra IS NULL THEN r.z * (r.hi - r.lo) + r.lo ELSE f.a * (exp(f.b) - 1) * (r.hi - r.lo) + r.lo END, 4) AS fitted, "
    "CASE WHEN x.j IS NULL THEN r.n - r.t + 0e0 ELSE floor(x.j * 25e0) END AS predicted_rul, CASE WHEN r.ra = r.t THEN 1::BIGINT ELSE 0 END AS refit FROM rr r LEFT JOIN fit f ON f.unit_id = r.unit_id AND f.ra = r.ra LEFT JOIN cross_at x ON x.unit_id = r.unit_id AND x.ra = r.ra",
)
def rolling_refit(spark, d):
    """The kernel with the grid's fit, threshold 0.9."""
    r = models.rolling_refit(supplies(spark, d).withColumn("threshold", F.lit(0.9)), "price", grid=True)
    return r.select("unit_id", "t", F.round("fitted", 4).alias("fitted"), "predicted_rul", F.col("refit").cast("int").alias("refit"))


@query("refit_points", f"WITH {SU} SELECT unit_id, t, last_value(CASE WHEN {DUE} THEN t END IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY t) AS refit_at FROM su")
def refit_points(spark, d):
    return models.refit_points(supplies(spark, d)).select("unit_id", "t", "refit_at")


