import base64
import gzip
import hashlib

import pyarrow.fs as pafs

from wearcurve.llm import common, warc

SCHEMA = "page_id long, url string, html string, host string, revisit boolean"
ROWS = [
    (1, "http://a/1", "<p>same</p>", None, None), (2, "http://a/2", "<p>same</p>", None, None), (3, "http://a/3", "<p>é😀\r\n\r\nx</p>", None, None), (4, None, None, None, None), (5, "http://a/5", "", None, None),
    (None, "http://a/n", "<p>same</p>", None, None), (6, "u\r\nX: y", "long " * 100_000, None, None), (7, "http://a/7", "tie", None, None), (7, "http://a/7", "tie", None, None), (None, "x", "alone", None, None),
]


def test_round_trip(spark):
    got = warc.round_trip(spark.createDataFrame(ROWS, SCHEMA), payloads=True).collect()
    assert len(got) == len(ROWS)
    for r in got:
        bodies = {(i, b or "") for i, _, b, _, _ in ROWS if i == r.page_id}
        match = [b for _, b in bodies if base64.b32encode(hashlib.sha1(b.encode()).digest()).decode() == r.payload_digest]
        assert len(match) == 1 and r.payload_bytes == len(match[0].encode())
        ids = [i for i, _, b, _, _ in ROWS if (b or "") == match[0] and i is not None]
        last = max(ids, default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == last else ("revisit", last))
        assert (r.payload.decode() if r.payload is not None else None) == (match[0] if r.record_type == "response" else None)
    assert next(r for r in got if r.page_id == 6).url == "u X: y"


def test_least_bytes(spark):
    got = {r.page_id: r.record_type for r in warc.round_trip(spark.createDataFrame(ROWS[:3], SCHEMA), least_bytes=100).collect()}
    assert set(got.values()) == {"response"}


def test_index_and_selection(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 50, None, None) for i in range(200)]
    folder = common.shared_dir(spark, "warc-test")
    index = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    for r in index.where("page_id % 50 = 0").collect():
        fs, inner = pafs.FileSystem.from_uri(r.archive)
        with fs.open_input_file(inner) as f:
            member = f.read_at(r.length, r.offset)
        assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: response") and f"urn:page:{r.page_id}>".encode() in gzip.decompress(member)
    got = warc.read(index.where("page_id % 3 = 0")).collect()
    assert sorted(r.page_id for r in got) == list(range(0, 200, 3)) and all(r.payload.decode() == f"<p>{r.page_id}</p>" * 50 for r in got)


def test_coalesced_ranges():
    rows = [(0, 10), (10, 5), (100, 10), (5000, 1), (5001, 100)]
    got = list(warc.coalesced(iter(rows), most=150, gap=90))
    assert [(a, b) for a, b, _ in got] == [(0, 110), (5000, 5101)]
    assert [m for _, _, ms in got for m in ms] == rows
    assert [(a, b) for a, b, _ in warc.coalesced(iter([(0, 1000), (1000, 10)]), most=100)] == [(0, 1000), (1000, 1010)]
    assert list(warc.coalesced(iter([]))) == []


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_roll_and_reads_are_split(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_LEAST", 2000)
    monkeypatch.setattr(warc, "RANGE", 1500)
    rows = [(i, f"http://h/{i}", hashlib.sha512(str(i).encode()).hexdigest() * 2, None, None) for i in range(60)]
    index = warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), common.shared_dir(spark, "warc-test"), archive_bytes=8000)
    sizes = {r[0]: r[1] for r in index.groupBy("archive").sum("length").collect()}
    assert len(sizes) > 2 and max(sizes.values()) <= 8000
    got = warc.read(index)
    assert got.rdd.getNumPartitions() > 4
    assert sorted((r.page_id, r.payload.decode()) for r in got.collect()) == [(i, b) for i, _, b, _, _ in rows]
