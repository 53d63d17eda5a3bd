import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD
from wearcurve.llm import shuffle


def test_fisher_yates_is_a_permutation_and_even():
    rng = np.random.default_rng(0)
    seen = Counter(tuple(shuffle.fisher_yates(3, rng)) for _ in range(6000))
    assert len(seen) == 6 and all(abs(n - 1000) < 150 for n in seen.values())
    assert sorted(shuffle.fisher_yates(1000, rng)) == list(range(1000))
    assert list(shuffle.fisher_yates(0, rng)) == []


@pytest.mark.parametrize("bucket", [50, 8192])
def test_slots_shards_and_growth(spark, docs, bucket):
    rows = [(i, f"text {i % 7}") for i in range(1000)]
    d = docs(rows)
    got = shuffle.shuffled(d, rows_per_bucket=bucket).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        t = dict(rows)[r.doc_id]
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        assert r.grown_shard in (r.shard, 8)
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.5 * 1000 / 8
    assert 60 < sum(r.grown_shard == 8 for r in got) < 170
    nine = {r.doc_id: r.shard for r in shuffle.shuffled(d, n_shards=9, rows_per_bucket=bucket).collect()}
    assert all(nine[r.doc_id] == r.grown_shard for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, shuffle.shuffled(d.repartition(7), rows_per_bucket=bucket).collect()))
    order = [r.doc_id for r in sorted((r for r in got if r.shard == 0), key=lambda r: r.slot)]
    assert order != sorted(order)


def test_odd_rows_and_empty(spark, docs):
    got = shuffle.shuffled(docs(ODD)).collect()
    assert len(got) == len(ODD)
    assert next(r for r in got if r.doc_id == 1).size == 1 and next(r for r in got if r.doc_id == 1).text_crc32 == 0
    assert shuffle.shuffled(docs([])).count() == 0


def test_buckets_of_carried_records_follow_bytes(spark, docs, monkeypatch):
    monkeypatch.setattr(shuffle, "BYTES_PER_BUCKET", 1000)
    d = docs([(i, f"text {i} " * 20) for i in range(200)])
    got = shuffle.shuffled(d, carry=("lang",), n_shards=2).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.carried.lang for r in got} == {"en"}


def test_written_shards_hold_all_columns(spark, docs, tmp_path):
    d = docs([(i, f"t{i}") for i in range(50)])
    shuffle.write_shards(d, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*d.columns, "shard_no"] and back.count() == 50 and back.where("shard <> 'x'").count() == 0


def test_results_are_read_from_written_shards(spark, docs, tmp_path, monkeypatch):
    from wearcurve.llm import queries

    rows = [(i, f"text {i} é") for i in range(300)] + [(300, None), (None, "null id"), (7, "again")]
    docs(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(shuffle, "shared_dir", lambda s, what: str(tmp_path / what))
    monkeypatch.setattr(shuffle, "BYTES_PER_BUCKET", 100)
    got = {(r.doc_id, r.size, r.text_crc32): (r.shard, r.slot) for r in queries.op5_sharding(spark, str(tmp_path)).collect()}
    shards = spark.read.parquet(str(tmp_path / "shards" / "t"))
    assert shards.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot_no", "shard_no"]
    body = lambda t: (t or "").encode()
    assert got == {(r.doc_id, len(body(r.text)) + 1, zlib.crc32(body(r.text))): (r.shard_no, r.slot_no) for r in shards.collect()} and len(got) == len(rows)
    assert sorted((i or -1, t or "") for i, t in rows) == sorted((r.doc_id or -1, r.text or "") for r in shards.collect())
    for folder in (tmp_path / "shards" / "t").glob("shard_no=*"):
        slots = [r.slot_no for f in sorted(folder.glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert len(list(folder.glob("*.parquet"))) > 1 and slots == list(range(len(slots)))


def test_lost_and_damaged_texts_show(spark, docs, monkeypatch):
    real = shuffle.write_shards

    def damaged(df, path, *a, **k):
        real(df.where("doc_id <> 3").withColumn("text", shuffle.F.expr("if(doc_id = 4, 'changed', text)")), path, *a, **k)

    monkeypatch.setattr(shuffle, "write_shards", damaged)
    got = {r.doc_id: r.size for r in shuffle.sharded(docs([(i, f"t{i}") for i in range(9)], extra=False)).collect()}
    assert 3 not in got and got[4] == 8 and got[5] == 3


def test_sharding_of_no_documents(spark, docs):
    assert shuffle.sharded(docs([], extra=False)).count() == 0
