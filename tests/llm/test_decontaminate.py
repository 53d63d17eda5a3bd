import random
import re

import numpy as np

from tests.llm.conftest import ODD
from wearcurve.llm import decontaminate

WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and", "to"] * 40


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def smith_waterman(x, y):
    best, last = 0, [0] * (len(y) + 1)
    for a in x:
        row = [0]
        for j, b in enumerate(y):
            row.append(max(0, last[j] + (2 if a == b else -1), last[j + 1] - 1, row[j] - 1))
        best, last = max(best, *row), row
    return best


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_planted_copies_equal_brute_force(spark, docs):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.choice([15, 30, 55]))) for k in range(12)]
    rows = []
    for i in range(80):
        t = prose(rng, rng.choice([5, 60, 200]))
        if i % 3 == 0:
            part = edited(rng, rng.choice(items)[1], rng.choice([0, 0.05, 0.15]))
            t = f"{t}. {part.upper() if i % 2 else part}, {prose(rng, 30)}"
        rows.append((i, t))
    rows += [(1000 + k, f"start {items[0][1]} end") for k in range(60)]  # an item that leaked into most documents
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(rows), bench(spark, items)).collect()}
    want = {}
    for d, t in rows:
        y = words(t)
        for k, item in items:
            x = words(item)
            s = smith_waterman(x, y)
            if s >= 0.5 * 2 * len(x) or s >= decontaminate.LONG_MATCH:
                want[d, k] = s
    assert got == want


def test_edited_copies_beside_one_exact_copy(spark, docs):
    item = [f"v{i}" for i in range(40)]
    edited_copy = [*item[:20], "changed", *item[21:]]
    rows = [(i, f"doc {i} {' '.join(edited_copy)} end") for i in range(100)] + [(100, f"x {' '.join(item)} y")]
    got = {r.doc_id: r.similarity for r in decontaminate.contaminated(docs(rows), bench(spark, [(1, " ".join(item))])).collect()}
    assert set(got) == set(range(101)) and got[100] == 1.0 and abs(got[0] - 77 / 80) < 1e-9


def test_bound_loses_no_hit(spark, docs):
    rng = random.Random(11)
    few = [f"u{i}" for i in range(12)]  # so that seeds occur everywhere
    items = [(k, " ".join(rng.choice(few) for _ in range(rng.choice([6, 20, 70])))) for k in range(9)]
    rows = [(i, " ".join(rng.choice(few + WORDS[:40]) for _ in range(15)) + " " + edited(rng, items[i % 9][1], rng.choice([0.1, 0.3]))) for i in range(60)]
    d, b = docs(rows), bench(spark, items)
    got = set(map(tuple, decontaminate.contaminated(d, b).collect()))
    with_all = decontaminate._passages
    try:
        decontaminate._passages = lambda w, items, similarity: with_all(w, items, 0.0)
        every = set(map(tuple, decontaminate.contaminated(d, b).collect()))
    finally:
        decontaminate._passages = with_all
    assert got == every and len(got) >= 60


def test_spans_and_blocks(spark, docs, monkeypatch):
    rng = random.Random(9)
    items = [(k, prose(rng, 30)) for k in range(6)]
    rows = [(1, f"a b c {items[4][1]} d e"), (2, prose(rng, 100)), (3, f"{items[1][1]} {prose(rng, 500)} {items[1][1]}")]
    monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", 2)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(rows), bench(spark, items)).collect()}
    assert set(got) == {(1, 4), (3, 1)}
    assert (got[1, 4].start_word, got[1, 4].end_word, got[1, 4].similarity) == (3, 33, 1.0)
    assert (got[3, 1].start_word, got[3, 1].end_word) == (0, 30)


def test_odd_rows_and_empty(spark, docs):
    items = [(1, "some quite long item text of several words here"), (2, None), (3, "two words"), (None, "null id here with some words")]
    got = decontaminate.contaminated(docs(ODD), bench(spark, items)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(None, None)]
    assert decontaminate.contaminated(docs([]), bench(spark, items)).count() == 0
    assert decontaminate.contaminated(docs(ODD), bench(spark, [])).count() == 0


def test_alignment_kernel():
    rng = random.Random(3)
    xs = [[rng.randrange(6) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    ys = [[rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(60)]
    to = lambda v: [np.array(x, np.uint64) + np.uint64(10) for x in v]
    best, _ = decontaminate.align(to(xs), to(ys))
    assert best.tolist() == [smith_waterman(x, y) for x, y in zip(xs, ys, strict=True)]
