import random
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.conftest import ODD
from wearcurve.llm import classifier

RNG = random.Random(8)
SYLLABLES = ["an", "er", "on", "ti", "sh", "bo", "ga", "é", "ó"]


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randrange(1, 5)))


def good(n=60):
    return " ".join(word() for _ in range(n))


def bad(n=60):
    return RNG.choice([lambda: " ".join(word() + "###" for _ in range(n)), lambda: good(n).upper() + "!!", lambda: " ".join([word()] * n), lambda: " | ".join(word() for _ in range(n))])()


def test_held_out_accuracy(spark, docs):
    rows, labels = [], []
    for i in range(900):
        y = int(RNG.random() < 0.7)
        rows.append((i, good() if y else bad()))
        labels.append((i, y, 0))
    d, lab = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in classifier.scored(d, classifier.fit(d, lab)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    flags = {r.doc_id for r in d.where(classifier.held_out()).collect()}
    assert flags == set(held) and len(held) > 150
    assert np.mean([(got[i] >= 0.7) == bool(labels[i][1]) for i in held]) > 0.97
    flipped = spark.createDataFrame([(i, 1 - y if i in flags else y, 0) for i, y, _ in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in classifier.scored(d, classifier.fit(d, flipped)).collect()} == got  # held-out labels aren't read


def test_features_match_a_plain_count():
    texts = ["abc dé", "", "x x", "ñ😀ü€a é"]
    found = [(f, d) for f, d in classifier._features(pa.array(texts, pa.string()))]
    count = np.bincount(np.concatenate([d for _, d in found]), minlength=4)
    # words + pairs + runs of 1 to 4 characters in each word
    runs = lambda n: sum(max(0, n - k + 1) for k in classifier.CHARS)
    assert count.tolist() == [2 + 1 + runs(3) + runs(2), 0, 2 + 1 + 2 * runs(1), 2 + 1 + runs(5) + runs(1)]
    assert all(0 <= f.min() and f.max() < classifier.BUCKETS for f, _ in found if len(f))
    alone = classifier.Model(np.arange(classifier.BUCKETS, dtype=np.float32) / classifier.BUCKETS, 0.0)
    assert np.allclose(alone.score(pa.array(texts, pa.string())), [alone.score(pa.array([t], pa.string()))[0] for t in texts])


def characters(text, k):
    """Sorted buckets of the runs of k characters."""
    return sorted(list(classifier._features(pa.array([text])))[1 + k][0].tolist())


def test_runs_are_of_characters():
    assert characters("éa", 1) == sorted(characters("é", 1) + characters("a", 1))  # not of bytes
    assert characters("😀é", 2) == characters("x 😀é", 2) and len(characters("😀é€", 3)) == 1
    assert set(characters("éè", 1)) != set(characters("éé", 1))


def test_sample_bounds(spark, docs):
    rows = [(i, f"text {i} " * 10) for i in range(50)] + [(i, f"other text of {i}") for i in range(50)]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    seen = []
    old = classifier.train
    classifier.train = lambda texts, labels: seen.append(texts) or old(texts, labels)
    try:
        classifier.fit(docs(rows), lab)
        classifier.fit(docs(rows), lab, rows=10)
        classifier.fit(docs(rows), lab, size=100)
        classifier.fit(docs(rows), lab, size=1)
    finally:
        classifier.train = old
    assert len(seen[0]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(50)) and len(seen[1]) == 10
    assert all(t.startswith("other") for t in seen[0])  # the least text of an id
    assert 1 <= len(seen[2]) and sum(map(len, seen[2])) <= 100 and len(seen[3]) == 1


def test_query_scores_every_document(spark):
    from wearcurve.llm import queries

    got = {r.doc_id: r for r in queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.quality is not None}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [i for i in got if got[i].held_out and i in labels]
    assert len(held) > 50 and np.mean([got[i].predicted == labels[i] for i in held]) > 0.95


def test_odd_rows_empty_tables_and_single_class(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = classifier.fit(docs(ODD), none)
    got = classifier.scored(docs(ODD), model).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    assert classifier.scored(docs([]), model).count() == 0
    one = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (6, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert classifier.scored(docs(ODD), classifier.fit(docs(ODD), one)).first().score > 0.5
