import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import DOCS, LONG, ODD
from tests.llm.test_decontaminate import smith_waterman, words
from tests.llm.test_minhash import brute
from wearcurve.llm import packing


@pytest.fixture
def place(spark, tmp_path):
    spark.createDataFrame([(1, "what is the quick answer to this very long and quite special question of ours")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_equal_brute_force(spark, place):
    rng = random.Random(6)
    item = "what is the quick answer to this very long and quite special question of ours"
    text = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    rows = [(i, text(rng.choice([5, 25, 60]))) for i in range(60)]
    rows += [(100 + k, rows[k + 1][1] + (" tail" if k % 2 else "")) for k in range(20)]
    rows += [(200, f"{text(30)} {item.upper()} {text(10)}"), (201, f"{text(30)} token = abcdefgh123 {text(10)}"), (202, f"{text(40)} ###".replace(" ", "### "))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    docs.write.parquet(f"{place}/documents.parquet")
    kept = {i: t for i, t in rows if len(t.split()) >= 20 and i != 202}
    stages = dict(corpus_pipeline.STAGES)
    a = stages["quality_rules"](spark, docs, place)
    assert {r.doc_id for r in a.collect()} == set(kept)
    classes = brute(list(kept.items()), 5)
    b = stages["near_duplicates"](spark, a, place)
    one = {i: t for i, t in kept.items() if classes[i][1] == i}
    assert {r.doc_id for r in b.collect()} == set(one)
    c = stages["decontamination"](spark, b, place)
    clean = {i: t for i, t in one.items() if smith_waterman(words(item), words(t)) < len(words(item))}
    assert 200 not in clean and {r.doc_id for r in c.collect()} == set(clean)
    d = stages["secret_scan"](spark, c, place)
    told = {r.doc_id: r for r in d.collect()}
    assert "<assign>" in told[201].text and told[201].n_chars == len(told[201].text)
    assert all(told[i].text == t for i, t in clean.items() if i != 201)
    assert all(x.columns == docs.columns for x in (a, b, c, d))
    last = corpus_pipeline.run(spark, place).collect()
    assert Counter(r.doc_id for r in last) == Counter(set(clean))
    assert max(Counter(r.bin_id for r in last).values()) <= packing.PER_SOURCE


def test_odd_rows(spark, place):
    more = "some words that are enough for every rule to be kept in this pipeline of ours at all times yes"
    rows = [*ODD, (7, more + " a b c d e f g"), (7, more + " different end of it x y z q r"), (None, more + " one two three four five six"), (8, more.replace("some", LONG[:30]) + " and more of it so that it is not near to any of the others here")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    from pyspark.sql import functions as F

    docs = docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("x")).withColumn("row", F.lit("x"))
    d = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, place)
        assert d.columns == docs.columns
    ids = Counter(r.doc_id for r in d.collect())
    assert ids == {7: 1, 8: 1, None: 1}


def test_empty(spark, place):
    docs = spark.createDataFrame([], DOCS)
    docs.write.parquet(f"{place}/documents.parquet")
    assert corpus_pipeline.run(spark, place).count() == 0
