"""Operators on small tables: edge cases, properties, the stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearcurve import functions as fn
from wearcurve.operators import evaluation, extraction, features, life, models, rating, retrieval, runner, scaling, summary, text, trackers
from wearcurve.operators.units import trajectory
from wearcurve.plans import fixtures
from wearcurve.sources import datasets, writers
from wearcurve.streaming import pid as stream_pid


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("c", "p", "rpm", "e", "low", "high"), [(14.8, 0.5, 1797, 3, 100, 1e9), (90.3, 26.69, 2000, 10 / 3, 50, 2000), (12, 12, 2100, 3, 5, 10), (12, 11, 2250, 3, 7, 12), (12, 10, 2400, 3, 10, 15)])
def test_rating_life(spark, c, p, rpm, e, low, high):
    assert low < value(spark, rating.l10_hours(c, p, rpm, e)) < high


def test_rating_life_needs_positive_input(spark):
    with pytest.raises(Exception, match="positive"):
        value(spark, rating.l10_hours(F.col("id") * 0.0 + 1, F.col("id") * 0.0, F.lit(10.0)))


def test_defect_frequencies(spark):
    f = {k: value(spark, c) for k, c in rating.defect_frequencies(2100, *rating.GEOMETRIES["xjtu_sy"]).items()}
    assert f["bpfo"] > 0 and f["bpfi"] > f["bpfo"] and f["ftf"] < f["bsf"]
    assert value(spark, rating.bearing_load_kn(2.0, 0.0)) == pytest.approx(0.00981)


def steps(spark, values, unit=1, **more):
    return spark.createDataFrame([(unit, t, len(values), *v) if isinstance(v, tuple) else (unit, t, len(values), v) for t, v in enumerate(values)], "unit_id long, t long, n long, value double")


def test_baselines(spark):
    rows = steps(spark, [0.0] * 200).select("t", rating.baseline().alias("b"), rating.baseline(shape="linear").alias("l"), rating.linear_fade().alias("f")).orderBy("t").collect()
    b = [r.b for r in rows]
    assert b[0] == 0 and b[-1] == pytest.approx(1) and all(x <= y for x, y in zip(b, b[1:])) and rows[0].f == 1
    assert steps(spark, [1.0]).select(rating.baseline().alias("b")).first().b == 0
    with pytest.raises(ValueError, match="shape"):
        rating.baseline(shape="round")


def test_trajectory_and_lives(spark):
    d = spark.createDataFrame([(1, 30, "c"), (1, 10, "a"), (2, 5, "z"), (1, 20, "b")], "u long, ts long, v string")
    got = {(r.unit_id, r.t): (r.n, r.v) for r in trajectory(d, "u", ["ts"], v="v").collect()}
    assert got == {(1, 0): (3, "a"), (1, 1): (3, "b"), (1, 2): (3, "c"), (2, 0): (1, "z")}
    s = life.end_of_life(steps(spark, [1.0, 0.9, 0.79, 0.85, 0.7]), "value").orderBy("t").collect()
    assert [r.true_rul for r in s] == [2, 1, 0, 0, 0] and s[0].failure_index == 2
    assert life.end_of_life(steps(spark, [1.0, 0.9]), "value").where("true_rul IS NOT NULL OR failure_index IS NOT NULL").count() == 0
    assert [r.x for r in steps(spark, [0.0] * 3).select("t", life.linear().alias("x")).orderBy("t").collect()] == [3, 1.5, 0]


def test_scaling(spark):
    assert {r.x for r in steps(spark, [4.0, 4.0]).select(scaling.minmax("value").alias("x")).collect()} == {0.0}
    h = scaling.healthy_threshold(steps(spark, [3.0] * 20), "value").first()
    assert h.healthy_mean == 3 and h.threshold == 4
    fleet = scaling.fleet_prior(steps(spark, [1.0, 2.0, 3.0]).union(steps(spark, [10.0], 2)), "value").orderBy("t").collect()
    assert [r.prior for r in fleet] == [5.5, 6.0, 6.5]
    assert spark.createDataFrame([(1.0, math.nan), (3.0, 5.0)], "a double, b double").select(scaling.row_mean(["a", "b"]).alias("m")).collect() == [(1.0,), (4.0,)]


def test_frames_and_moments(spark):
    d = steps(spark, [float(k % 5) for k in range(20)])
    by_rows = {(r.frame, r.rms) for r in features.framed_features(d, "value", 8, 4, 1.0).select("frame", F.round("rms", 9).alias("rms")).collect()}
    sliced = features.frames(features.signals(d, "value"), 8, 4, 1.0)
    by_slices = {(r.frame, round(float(np.sqrt(np.mean(np.square(r.samples)))), 9)) for r in sliced.collect()}
    assert by_rows == by_slices and len(by_rows) == 4
    assert features.frames(features.signals(steps(spark, [1.0] * 3), "value"), 8, 4, 1.0).count() == 0 and features.framed_rows(steps(spark, [1.0] * 3), 8, 4).count() == 0
    flat = features.unit_features(steps(spark, [2.0] * 5), "value").first()
    assert flat.kurtosis is None and flat.skewness is None and flat.crest_factor == 1
    noise = features.unit_features(steps(spark, np.random.default_rng(1).normal(size=5000).tolist()), "value").first()
    assert noise.kurtosis == pytest.approx(3, abs=0.3) and noise.rms > 0


def test_severity_slices(spark, monkeypatch):
    rows = [(k, "ab"[k % 2] if k % 5 else "zz", 1.0) for k in range(100)]
    d = spark.createDataFrame(rows, "k long, phase string, s double")
    whole = sorted(map(tuple, features.severity_concat(d, "phase", ["k"], ["b", "none", "a"], "s").collect()))
    monkeypatch.setattr(features, "SLICE_ROWS", 7)
    assert whole == sorted(map(tuple, features.severity_concat(d, "phase", ["k"], ["b", "none", "a"], "s").collect()))
    assert sorted(x[-1] for x in whole) == list(range(80)) and {x[3] for x in whole} == {0.0, 40.0}


def test_units_of_very_different_lengths(spark):
    d = steps(spark, [0.1 * k for k in range(300)]).union(steps(spark, [1.0], 2)).union(steps(spark, [1.0, 2.0], 3))
    d = d.select("unit_id", "t", "n", F.col("value").alias("observed"), F.lit(0.0).alias("baseline"), F.lit(1.0).alias("threshold"))
    tracked = trackers.pid_track(d)
    assert tracked.count() == 303 and tracked.where("predicted_rul IS NULL").count() == 2 + 1 + 2
    last = {r.unit_id: round(r.cumulative, 9) for r in trackers.pid_final_state(d).collect()}
    assert last == {r.unit_id: round(r.cumulative, 9) for r in tracked.join(d.where("t = n - 1").select("unit_id", "t"), ["unit_id", "t"]).collect()}
    assert trackers.pid_track(d.where("t < 0")).count() == 0


def test_regime_runs(spark):
    d = spark.createDataFrame([(1, t, x) for t, x in enumerate("aabbba")], "unit_id long, t long, regime string")
    assert [(r.regime, r.start, r.end) for r in trackers.regime_runs(d).orderBy("run").collect()] == [("a", 0, 1), ("b", 2, 4), ("a", 5, 5)]


def test_alarm(spark):
    d = steps(spark, [0.1] * 50 + [2.0] * 50)
    r = models.first_crossings(d, "value").first()
    assert (r.first_warning, r.first_alert, r.first_danger, r.first_alarm) == (50, 50, 50, 50)
    assert models.first_crossings(d, "value", {"warning": 5.0}).first().first_alarm is None and models.alarm_level({}) == 1.0


def test_scores(spark):
    d = spark.createDataFrame([("a", 0.0, 1000.0), ("b", 100.0, 100.0), ("b", 50.0, 50.0), ("c", math.nan, 1.0), ("d", 1e9, 0.0)], "m string, predicted_rul double, actual_rul double")
    got = {r.m: r for r in evaluation.rul_metrics(d, ["m"]).collect()}
    assert got["a"].nasa_score <= 1e6 and (got["b"].rmse, got["b"].mae, got["b"].nasa_score) == (0, 0, 0) and got["c"].n_valid == 0 and got["c"].rmse is None and got["d"].nasa_score == 1e6
    a = spark.createDataFrame([(1, t, 8, int(t in (1, 5)), 7) for t in range(8)] + [(2, t, 3, 1, None) for t in range(3)], "u long, t long, n long, alarm int, failure_index int")
    r = {x.u: x for x in evaluation.detection_metrics(a, ["u"]).collect()}
    assert (r[1].detection_lead_time, r[1].detection_success, r[1].false_alarm_rate) == (6, True, 0.5) and r[2].false_alarm_rate is None


def bench_frame(spark, prior=True, rul=True, failure=True):
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.normal(3, 0.1, 150), 3 + np.linspace(0, 5, 50)])
    rows = [(1, t, 200, float(y[t]), t / 199 if prior else None, 4.0, float(199 - t) if rul else None, 199 if failure else None, "exact", "ball", True) for t in range(200)]
    return spark.createDataFrame(rows, "unit_id long, t long, n long, observed double, baseline double, threshold double, true_rul double, failure_index int, prior_quality string, equipment_type string, is_run_to_failure boolean")


def test_benchmark_variants(spark):
    rows = {r.model: r for r in runner.benchmark_rows(bench_frame(spark), "d").collect()}
    assert set(rows) == set(runner.MODELS) and all(r.n_valid == 200 for r in rows.values()) and rows["pid_adaptive"].rmse is not None and rows["threshold_alarm"].rmse is None
    none = {r.model: r for r in runner.benchmark_rows(bench_frame(spark, prior=False, rul=False, failure=False), "d").collect()}
    assert set(none) == {"threshold_alarm", "static_curve", "rolling_refit"} and none["static_curve"].rmse is None and none["static_curve"].detection_success is None
    short = runner.benchmark_rows(bench_frame(spark).where("t < 30").withColumn("n", F.lit(30).cast("long")), "d")
    assert "rolling_refit" not in {r.model for r in short.collect()}
    zero = spark.createDataFrame([(0.0,), (None,), (2.0,)], "threshold double").select(runner.level_or_one().alias("x"))
    assert [r.x for r in zero.collect()] == [1.0, 1.0, 2.0]
    both = runner.full_benchmark({"a": bench_frame(spark), "b": bench_frame(spark)}, wanted=["pid_adaptive", "pid_regime"])
    assert both.count() == 4 and summary.regime_benefit(both).count() == 2
    inner = summary.regime_benefit(both.where("NOT (dataset = 'a' AND model = 'pid_regime')"), "inner")
    assert [r.dataset for r in inner.collect()] == ["b"]


def test_text(spark):
    t = spark.createDataFrame([("  hello   world  \n\n\n  foo   bar  ",)], "text string").select(text.clean(F.col("text")).alias("x")).first().x
    assert t == "hello world\n\nfoo bar"
    kinds = {"6205 25 52 15 14.8 7.8 0.335\n6206 30 62 16 20.3 11.2": "table", "This is a plain sentence.": "prose", "  \n ": "mixed"}
    got = {r.text: r.k for r in spark.createDataFrame([(k,) for k in kinds], "text string").select("text", text.content_type(F.col("text")).alias("k")).collect()}
    assert got == kinds
    assert value(spark, text.section_header(F.lit("intro text\n1.2 Ratings\nMOUNTING"))) == "1.2 Ratings"
    assert value(spark, text.maker(F.lit("mounted.pdf"), F.lit("by LDK"))) == "LDK" and value(spark, text.maker(F.lit("skf.pdf"), F.lit("LDK"))) == "SKF"
    pages = spark.createDataFrame([("s", k, f"HEAD\nbody {k}\nmore\nlast {k}") for k in range(5)] + [("few", 1, "HEAD\nx")], "source string, page int, text string")
    kept = {(r.source, r.page): r.text for r in text.strip_repeated(pages).collect()}
    assert kept["s", 2] == "body 2\nlast 2" or kept["s", 2] == "body 2\nmore\nlast 2"
    assert kept["few", 1] == "HEAD\nx"
    chunks = text.ingest(pages.withColumn("text", F.concat("text", F.lit(" and some more words that make the page long enough")))).collect()
    assert {r.chunk_id for r in chunks} == {f"s__p{k}__c0" for k in range(5)} | {"few__p1__c0"}


def test_designations(spark):
    want = {"6205-2RS drive end": "6205-2RS", "the ZA-2115": "ZA-2115", "UER204 unit": "UER204", "nothing": None}
    got = {r.q: r.d for r in spark.createDataFrame([(k,) for k in want], "q string").select("q", fn.designation(F.col("q")).alias("d")).collect()}
    assert got == want
    bores = {"6205": 25.0, "6204": 20.0, "UER204": 20.0, "ZA-2115": 49.2, "x": None}
    assert {r.q: r.b for r in spark.createDataFrame([(k,) for k in bores], "q string").select("q", fn.bore_mm(F.col("q")).alias("b")).collect()} == bores
    assert value(spark, fn.plausible(F.lit(25.0), F.lit(14.8), F.lit("ball"))) and not value(spark, fn.plausible(F.lit(25.0), F.lit(200.0), F.lit("ball")))
    assert value(spark, fn.clip(F.lit(math.nan), F.lit(0.0), F.lit(1.0))) == 1


def test_retrieval(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(80, 8))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = retrieval.knn(d.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding"), d, 4).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(3):
        best = np.argsort(-(u @ u[q]))[:4].tolist()
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: -r.score)] == best
    hits = retrieval.hybrid(fixtures.queries(spark), fixtures.queries(spark).limit(0).selectExpr("query_id", "query AS chunk_id", "0D AS score"), fixtures.catalog(spark))
    top = {}
    for r in sorted(hits.collect(), key=lambda r: -r.score):
        top.setdefault(r.query_id, r)
    assert "20,300" in top[2].text and 4 not in top
    assert value(spark, F.size(retrieval.search_terms(F.lit("UER204")))) == 5


def test_extraction(spark):
    from wearcurve.plans.texts import _hits

    got = {r.designation: r for r in extraction.extract(extraction.bearings(spark), _hits(spark)).collect()}
    assert set(got) == {"6205", "6204", "ZA-2115", "UER204"}
    assert got["6205"].c_kn == 14.8 and got["6205"].extraction_confidence == "high" and got["ZA-2115"].c_kn == 90.3 and got["ZA-2115"].source_file == "rexnord_catalogo.pdf"
    empty = extraction.extract(extraction.bearings(spark), _hits(spark).limit(0)).collect()
    assert {r.extraction_confidence for r in empty} == {"fallback"} and {r.source_file for r in empty} == {"ground_truth"}
    closest = {r.designation: r.c_kn for r in extraction.extract(extraction.bearings(spark), _hits(spark), use_known=True).collect()}
    assert closest["6204"] == 13.5
    assert extraction.report(extraction.extract(extraction.bearings(spark), _hits(spark)), extraction.bearings(spark)).count() == 4


def test_retrieval_end_to_end(spark):
    chunks = fixtures.catalog(spark)
    hits = retrieval.retrieve(fixtures.queries(spark), chunks, 3).collect()
    best = {}
    for r in sorted(hits, key=lambda r: (-r.score, r.chunk_id)):
        best.setdefault(r.query_id, r.text)
    assert set(best) == {1, 2, 3, 4, 5, 6, 7} and "bearings" in best[4].lower() and "20,300" in best[2]
    counted = retrieval.embed(chunks, "chunk_id", encode=lambda texts: [[len(t), 1.0] for t in texts]).collect()
    assert {r.chunk_id: r.embedding[0] for r in counted} == {r.chunk_id: len(r.text) for r in chunks.collect()}
    got = {r.designation: (r.c_kn, r.extraction_confidence) for r in extraction.run(chunks).collect()}
    assert got["6205"] == (14.8, "high") and got["ZA-2115"] == (90.3, "high") and set(got) == {"6205", "6204", "ZA-2115", "UER204"}


def test_priors_and_conditions(spark):
    p = spark.createDataFrame([(100.0, [float(k) for k in range(50)], 1.0, "h", "x", "exact", {"a": "1"})], writers.PRIOR)
    back = writers.prior_from_json(writers.prior_json(p)).first()
    assert back.expected_life == 100 and len(back.baseline_curve) == 50 and back.parameters == {"a": "1"}
    lives = {(r.dataset, r.condition): r.l10_hours for r in datasets.condition_lives(spark).collect()}
    assert 5 < lives["xjtu_sy", 1] < 10 and 7 < lives["xjtu_sy", 2] < 12 and 10 < lives["xjtu_sy", 3] < 15
    assert datasets.datasets(spark).count() == 6


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(u, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}", float(rng.normal(0, 1 + 3 * (t > 60))), 0.0, 2.0) for t in range(120) for u in (1, 2, 3)]
    d = spark.createDataFrame(rows, "unit_id long, ts string, observed double, baseline double, threshold double").withColumn("ts", F.to_timestamp("ts"))
    for k in range(3):  # three micro-batches, in order of time
        d.where((F.minute("ts") * 60 + F.second("ts")).between(40 * k, 40 * k + 39)).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    flat = tmp_path / "flat"
    flat.mkdir()
    q = None
    for k in range(3):
        for f in (tmp_path / "in" / f"p{k}").glob("*.parquet"):
            f.rename(flat / f"{k}-{f.name}")
        q = stream_pid.stream(spark.readStream.schema(d.schema).parquet(str(flat))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, stream_pid.batch(d).collect())) and len(got) == 360 and q is not None
    assert any(r[5] == "accelerated" for r in got)


def test_tick_aggregates(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 10:00:00", 3.0), (1, "2024-01-02 10:00:00", 5.0)], "unit_id long, ts string, observed double").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    s = stream_pid.tick_aggregates(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("ticks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.mean) for r in spark.table("ticks").collect()] == [(2, 2.0)]


def test_knn_takes_the_smaller_id_of_equals_in_every_batch(spark, monkeypatch):
    """Against brute force, with repeated vectors, zeros and nulls, batches of a few vectors and several blocks of queries."""
    rng = np.random.default_rng(3)
    rows = [(f"v{i:03d}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [("w1", [0.0] * 4), ("w0", [1.0, 0.0, 0.0, 0.0]), ("w2", [2.0, 0.0, 0.0, 0.0])]
    asked = [(i, v) for i, (_, v) in enumerate(rows[::5])]
    monkeypatch.setattr(retrieval, "SCORES", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    vectors = spark.createDataFrame([*rows, ("gone", None)], "vec_id string, embedding array<double>").repartition(3)
    got = retrieval.knn(spark.createDataFrame([*asked, (99, None)], "query_id long, embedding array<double>"), vectors, 4).collect()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = {(q, v, s) for q, a in asked for s, v in sorted(((round(float(unit(a) @ unit(b)), 9) + 0.0, v) for v, b in rows), key=lambda x: (-x[0], x[1]))[:4]}
    assert {(r.query_id, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert retrieval.knn(vectors.limit(0).withColumnRenamed("vec_id", "query_id"), vectors, 4).count() == 0


def test_kernels_over_a_unit_of_many_batches(spark, monkeypatch):
    """Units longer than a block stay whole, short ones share blocks."""
    from wearcurve.operators import units

    monkeypatch.setattr(units, "BLOCK_ROWS", 50)
    lengths = {1: 3, 2: 400, 3: 1, 4: 60, 5: 2}
    df = spark.createDataFrame([(u, t, float(t)) for u, n in lengths.items() for t in range(n)], "unit_id long, t long, x double").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = units.per_unit(df, ["x"], lambda x, n: {"total": np.cumsum(np.nan_to_num(x["x"]), axis=1)}, "total double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.unit_id, r.t): r.total for r in got} == {(u, t): t * (t + 1) / 2 for u, n in lengths.items() for t in range(n)}
