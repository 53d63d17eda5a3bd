"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_kernels import mat_file, numeric, structure
from wearcurve.operators.runner import RESULT
from wearcurve.sources import readers, writers


def test_engines(spark, tmp_path):
    line = lambda u, c: " ".join([str(u), str(c), *["0.5"] * 3, *[f"{k}.25" for k in range(21)]])
    (tmp_path / "test.txt").write_text("\n".join([line(1, 1), line(1, 2) + "  ", line(4, 1), ""]))
    (tmp_path / "rul.txt").write_text("112 \n98\n")
    d = readers.engines(spark, str(tmp_path / "test.txt"))
    assert len(d.columns) == 26 and d.count() == 3 and d.where("s_21 = 20.25").count() == 3
    lives = readers.engine_lives(spark, str(tmp_path / "rul.txt"))
    assert {(r.unit_nr, r.last_rul) for r in readers.engine_tests(d, lives).collect()} == {(1, 112.0), (4, 98.0)}


def test_snapshots(spark, tmp_path):
    folder = tmp_path / "ims"
    folder.mkdir()
    for name, width in (("2004.02.12", 8), ("2004.02.11", 8), ("2004.02.13", 3)):
        (folder / name).write_text("\n".join("\t".join(str(10 * r + c) for c in range(width)) for r in range(4)))
    (folder / "2004.02.14").write_text("broken x\n")
    d = readers.ims(spark, str(folder), True)
    got = {(r.unit_id, r.snapshot): r.samples for r in d.collect()}
    assert len(got) == 8 and got["bearing_2", 0] == [2.0, 12.0, 22.0, 32.0]
    assert {r.file for r in d.where("snapshot = 0").collect()} == {"2004.02.11"}


def test_numbered_snapshots(spark, tmp_path):
    for k in (10, 2, 1):
        (tmp_path / f"{k}.csv").write_text(f"{k}.5,0\n{k}.25,1\n")
    got = {r.snapshot: r.samples for r in readers.xjtu(spark, str(tmp_path), "u").collect()}
    assert got == {0: [1.5, 1.25], 1: [2.5, 2.25], 2: [10.5, 10.25]}


def test_two_axis_recordings(spark, tmp_path):
    (tmp_path / "acc_00001.csv").write_text("1,2\n3,4\n")
    (tmp_path / "acc_00002.csv").write_text("5\n6\n")
    got = {r.snapshot: (r.horizontal, r.vertical) for r in readers.femto(spark, str(tmp_path), "b").collect()}
    assert got == {0: ([1.0, 3.0], [2.0, 4.0]), 1: ([5.0, 6.0], [0.0, 0.0])}


def test_mat(spark, tmp_path):
    (tmp_path / "a.mat").write_bytes(mat_file(numeric("X097_FE_time", [0.0]), numeric("X097_DE_time", [1.0, 2.0, 3.0])))
    assert readers.mat_signals(spark, str(tmp_path / "a.mat")).first().samples == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="no variable"):
        readers.mat_signals(spark, str(tmp_path / "a.mat"), "none").collect()
    (tmp_path / "b.mat").write_bytes(mat_file(structure("Cell1", {"capacity": [740.0 - k for k in range(12)]}), structure("Cell2", {"capacity": [1.0, 2.0]})))
    got = readers.battery_capacity(spark, str(tmp_path / "b.mat")).orderBy("cycle").collect()
    assert len(got) == 12 and got[0].cell == "Cell1" and got[0].soh == 1.0 and got[11].cycle == 12


def test_metrics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", "u1", "pid", "exact", "ball", True, 10, 1.5, None, 2.0, 0.5, None, 0.0, True), ("d", "u2", "pid", "exact", "ball", False, 10, 1.5, None, 2.0, 0.5, 2155, 0.0, None)], RESULT)
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "m"))
    back = readers.metrics_csv(spark, {"d": str(tmp_path / "m"), "gone": str(tmp_path / "none")})
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "old.csv").write_text("unit_id,model,detection_lead_time,detection_success\nu,pid,2155.0,1.0\n")
    old = readers.metrics_csv(spark, {"old": str(tmp_path / "old.csv")}).first()
    assert (old.dataset, old.detection_lead_time, old.detection_success, old.rmse) == ("old", 2155, True, None)
    with pytest.raises(FileNotFoundError):
        readers.metrics_csv(spark, {"x": str(tmp_path / "none")})
    writers.metrics(rows, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2


def test_params(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"6205": {"manufacturer": "SKF", "C_kn": 14.8, "bore_mm": 25.0}, "6204": {"C_kn": 13.5}}, indent=1))
    got = {r.designation: r.c_kn for r in readers.params_json(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"6205": 14.8, "6204": 13.5}
    writers.params(spark.createDataFrame([("6205", 14.8, "long text")], "designation string, c_kn double, raw_text string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["c_kn", "designation"]


def test_pdf_pages_with_a_pluggable_reader(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}.pdf").write_bytes(b"page one of the file with enough text to be kept in it|short|" + b"page three also has enough text to be kept here now")
    d = readers.pdf_pages(spark, str(tmp_path / "*.pdf"), lambda content: content.decode().split("|"))
    got = {(r.source, r.page) for r in d.collect()}
    assert got == {(f"f{k}.pdf", p) for k in range(2) for p in (1, 3)}


def test_cache_and_sinks(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    path = str(tmp_path / "c")
    assert readers.cached(spark, path, make).count() == 5 and readers.cached(spark, path, make).count() == 5 and made == [1]
    chunks = spark.createDataFrame([("a__p1__c0", "a", 1, "h", "prose", "SKF", 3, "x y z")], "chunk_id string, source string, page long, section_header string, content_type string, manufacturer string, word_count long, text string")
    for _ in range(2):
        writers.chunks(chunks, str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 1
    writers.inventory(chunks, str(tmp_path / "i"))
    assert "text" not in spark.read.option("header", True).csv(str(tmp_path / "i")).columns
    writers.features(spark.createDataFrame([(1, 2.0)], "unit_id long, rms double"), str(tmp_path / "f"))
    writers.fleet_prior(spark.createDataFrame([(0, 2.0)], "t long, prior double"), str(tmp_path / "fp"))
    assert spark.read.parquet(str(tmp_path / "fp")).columns == ["t", "prior"]
    assert writers.append_observation(spark.range(1).withColumn("a", F.lit(1)), spark.range(1)).where("a IS NULL").count() == 1


def test_inventory_keeps_texts(spark, tmp_path):
    """A header cut to 120 characters may end in a blank; names may hold quotes, line ends or nothing."""
    texts = ["h", "1 " * 60, " h ", "", None, "\x00", 'a"b', '"', "a\\", 'a\\"b', "a,b", "#a", "a\nb", "a\r\nb", "\r", 'a"\n,"b"\\']
    rows = [(f"s__p{k}__c0", x, k, x, "prose", "SKF", 3) for k, x in enumerate(texts)]
    writers.inventory(spark.createDataFrame(rows, writers.INVENTORY).repartition(2), str(tmp_path))
    d = readers.inventory(spark, str(tmp_path))
    assert sorted(tuple(r) for r in d.collect()) == sorted(rows)


def test_chunk_store_keeps_cut_headers(spark, tmp_path):
    """The header's 120th character is a blank, and one source has no name."""
    from wearcurve.plans import catalogue

    header = "1.10 " + "word " * 30
    docs = [(k, s, f"{header}\nand more words that make the page long enough") for k, s in enumerate(["s", ""])]
    spark.createDataFrame([(k, t, "en", s, len(t)) for k, s, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.chunk_id: (r.source, r.section_header) for r in catalogue.QUERIES["chunk_store"](spark, str(tmp_path)).collect()}
    assert got == {f"{s}__p1__c0": (s, header[:120]) for s in ("s", "")}


def noise(rng, n, spike=0.0):
    x = rng.normal(size=n)
    x[:: max(1, n // 8)] += spike
    return x


def test_bearing_loaders(spark, tmp_path):
    import numpy as np

    from wearcurve.sources import loaders

    rng = np.random.default_rng(1)
    for k in range(12):
        np.savetxt(tmp_path / f"2004.02.{k:02d}", np.stack([noise(rng, 200, k) for _ in range(4)], 1), delimiter="\t")
    d = loaders.ims(spark, str(tmp_path), False, ["bearing_1"])
    got = {(r.unit_id, r.t): r for r in d.collect()}
    assert len(got) == 48 and got["bearing_1", 3].failure_index == 11 and got["bearing_2", 3].failure_index is None and got["bearing_1", 11].true_rul == 0 and got["bearing_1", 0].true_rul == pytest.approx(11 / 6)
    assert got["bearing_1", 11].baseline == pytest.approx(got["bearing_1", 11].threshold) and {"bpfo_energy", "ftf_energy", "kurtosis"} <= set(d.columns)
    x = tmp_path / "x"
    x.mkdir()
    for k in range(3):
        np.savetxt(x / f"{k + 1}.csv", np.stack([noise(rng, 64)] * 2, 1), delimiter=",")
        np.savetxt(x / f"acc_{k:05d}.csv", np.stack([noise(rng, 64)] * 2, 1), delimiter=",")
    one = x / "one"
    one.mkdir()
    for f in list(x.glob("acc_*.csv")):
        f.rename(one / f.name)
    assert loaders.xjtu(spark, str(x), "Bearing1_1", 1).count() == 3
    f = loaders.femto(spark, str(one), "Bearing1_1", 1).collect()
    assert len(f) == 3 and f[0].rms_combined > f[0].rms and loaders.femto(spark, str(one), "b", 1, train=False).where("true_rul IS NOT NULL").count() == 0
    assert loaders.dataset_info(spark, "ims").count() == 1 and loaders.mat_key(97) == "X097_DE_time"


def test_severity_loader(spark, tmp_path):
    import numpy as np

    from wearcurve.sources import loaders

    rng = np.random.default_rng(2)
    for k, name in enumerate(("n", "a")):
        (tmp_path / f"{name}.mat").write_bytes(mat_file(numeric(loaders.mat_key(97 + k), noise(rng, 6000, 3 * k))))
    d = loaders.cwru(spark, {"normal": str(tmp_path / "n.mat"), "0.014": str(tmp_path / "a.mat"), "0.021": str(tmp_path / "gone.mat")})
    rows = d.orderBy("t").collect()
    assert [r.phase for r in rows] == ["healthy"] * 4 + ["moderate"] * 4 and [r.t for r in rows] == list(range(8))
    assert rows[4].seconds == pytest.approx(0.5 + 0.1) and rows[0].true_rul == 8 and rows[7].true_rul == 0


def test_engine_and_battery_loaders(spark, tmp_path):
    from wearcurve.operators import runner
    from wearcurve.sources import loaders

    line = lambda u, c, n: " ".join([str(u), str(c), "0", "0", "0", *[str(k + c / n) for k in range(21)]])
    (tmp_path / "train.txt").write_text("\n".join(line(u, c, n) for u, n in ((1, 5), (2, 3)) for c in range(1, n + 1)))
    (tmp_path / "test.txt").write_text("\n".join(line(7, c, 5) for c in range(1, 4)))
    (tmp_path / "rul.txt").write_text("20\n")
    got = {(r.unit_id, r.t): r for r in loaders.engines(spark, *[str(tmp_path / f"{x}.txt") for x in ("train", "test", "rul")]).collect()}
    assert len(got) == 11 and got["train_1", 0].true_rul == 4 and got["test_7", 0].true_rul == 22 and got["test_7", 2].true_rul == 20 and got["test_7", 0].failure_index is None
    assert got["train_1", 4].value > got["train_1", 0].value and got["train_1", 0].expected_life == 5
    assert runner.level_or_one() is not None
    (tmp_path / "b.mat").write_bytes(mat_file(structure("Cell1", {"capacity": [740.0 * (1 - 0.03 * k) for k in range(12)]})))
    b = loaders.batteries(spark, str(tmp_path / "b.mat")).orderBy("t").collect()
    assert b[0].failure_index == 7 and b[7].true_rul == 0 and b[0].phase == "linear" and b[11].phase == "rapid"
