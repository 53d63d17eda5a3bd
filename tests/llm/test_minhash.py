import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD
from wearcurve.llm import kernels, minhash


def sets(rows, n):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    return out


def brute(rows, n, percent=80):
    s = sets(rows, n)
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    while len(rows) < n:
        kind = rng.random()
        if kind < 0.4 or not rows:
            t = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 20, 60, 120])))
        else:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w) if kind < 0.9 else " ".join(w).upper()
        rows.append((len(rows), t))
    return rows


@pytest.mark.parametrize(("seed", "n"), [(1, 4), (2, 5)])
def test_components_equal_brute_force(spark, docs, seed, n):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows), n).collect()}
    assert got == brute(rows, n)


def test_chains_of_near_copies(spark, docs):
    """Neighbours are linked, ends are not, and one large group of copies."""
    w = [f"x{i}" for i in range(60)]
    rows = []
    for k in range(12):
        w[5 * k % 60] = f"y{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, "the same text again and again " * 3) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows), 4).collect()}
    assert got == brute(rows, 4)


def test_odd_rows(spark, docs):
    got = minhash.near_duplicates(docs(ODD), 4).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[2][:0] + [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)] and by[4] == [(1, 4, True)]
    assert by[5] == [(4, 5, True)] * 2 and by[None] == [(3, None, True)]
    assert minhash.near_duplicates(docs([]), 4).count() == 0


def test_components_of_graphs(spark):
    rng = random.Random(5)
    edges = [(a, a + 1) for a in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_sketches_estimate():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400, dtype=np.int64).astype(np.uint64)
    for same, low, high in ((400, 0, 0), (356, 20, 90), (100, 90, 180)):
        other = np.concatenate([base[:same], rng.integers(0, 1 << 62, 400 - same, dtype=np.int64).astype(np.uint64)])
        _, sketch = minhash.signatures([np.unique(base), np.unique(other)])
        assert low <= int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) <= high
        fine = int(np.bitwise_count(minhash.fine_sketch(np.unique(base)) ^ minhash.fine_sketch(np.unique(other))).sum())
        jaccard = same / (800 - same)
        assert bool(minhash.may_reach(np.array([fine]), np.array([800]), 80)[0]) or jaccard < 0.8
        assert not (jaccard < 0.5 and minhash.may_reach(np.array([fine]), np.array([800]), 80)[0])


def test_kernel_words():
    texts = ["Ab  cD\té\n", "", None, "x", " lead trail "]
    w = kernels.Words(pa.array(texts, pa.string()))
    assert [w.text(k) for k in range(len(w.hash))] == ["ab", "cd", "é", "x", "lead", "trail"]
    assert w.first.tolist() == [0, 3, 3, 3, 4, 6]
    again = kernels.Words(pa.array(["zz ab"], pa.string()))
    assert again.hash[1] == w.hash[0]
    assert [(i, j) for i, j in kernels.chunks(pa.array(["a" * 10, "b" * 10, "c" * 30, "d"]), 20)] == [(0, 2), (2, 3), (3, 4)]


def test_ids_with_several_texts(spark, docs):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs([(6, a), (6, b), (3, b), (9, a), (7, a + " more"), (8, "alone"), (8, "quite alone")]), 4).collect())
    assert got == [(3, 3, 3, True), (6, 3, 3, False), (6, 4, 3, False), (7, 5, 3, False), (8, 1, 8, True), (8, 1, 8, True), (9, 4, 3, False)]


def test_edited_copies_of_one_original(spark, docs):
    """The original comes last, and no two of its copies are similar."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(300):
        w = list(base)
        for j in rng.sample(range(200), 4):
            w[j] = f"n{k}x{j}"
        rows.append((k, " ".join(w)))
    rows.append((1000, " ".join(base)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows), 4).collect()}
    assert got == brute(rows, 4) and {c for _, c in got.values()} == {0}


def test_buckets_of_documents_that_are_not_similar(spark, docs):
    """Pairs just below the threshold share buckets, so the waves ask; groups among them are found."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(150):
        if k % 3 and rows:
            w = rows[-1][1].split(" ")
            w[rng.randrange(100)] = f"m{k}"
        else:
            w = list(base)
            for j in rng.sample(range(100), 5):
                w[j] = f"n{k}x{j}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows), 4).collect()}
    assert got == brute(rows, 4) and len({c for _, c in got.values()}) > 20


def test_recall_by_similarity(spark, docs):
    rng = random.Random(10)
    rows, pairs = [], []
    for k in range(400):
        w = [f"v{rng.randrange(5000)}" for _ in range(150)]
        e = list(w)
        for j in rng.sample(range(150), rng.randrange(1, 5)):
            e[j] = f"e{k}x{j}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(e))]
    s = sets(rows, 4)
    component = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), 4).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        pairs = [k for k in range(400) if low <= len(s[2 * k] & s[2 * k + 1]) / len(s[2 * k] | s[2 * k + 1]) < high]
        found = [component[2 * k] == component[2 * k + 1] for k in pairs]
        assert len(pairs) > 20 and sum(found) >= 0.99 * len(found)


def test_rows_dealt_for_one_hot_bucket(spark):
    """20,000 members that are similar to none: the first waves deal each member once, the last one once for each block of askers."""
    n, block = 20_000, minhash.BLOCK
    rows = spark.range(n).selectExpr("7L AS key", "id", "0L AS rep", "if(id = 5, 9L, 1L) AS links", "id AS component").union(spark.createDataFrame([(8, k, 0, 1, 0) for k in range(50)], "key long, id long, rep long, links long, component long"))
    blocks = -(-n // block)
    for wave, reps in enumerate(minhash.WAVES):
        roles, more = minhash._roles(rows, wave, reps)
        held = roles.where("held").count()
        sizes = [r.n for r in minhash.dealt(roles).groupBy("key", "part", "block").agg({"id": "count"}).toDF("key", "part", "block", "n").collect()]
        if reps is None:
            assert not more and held == n and sum(sizes) == (n - 1) * blocks + held * blocks
        else:
            assert more and 1 <= held < 2 * reps + 20 and sum(sizes) == n - 1 + held * blocks
        assert max(sizes) < 2.2 * block


def test_hashes_of_words():
    flip = str.maketrans("ab", "ba")
    x = "a"
    while len(x) < 1 << 12:
        x += x.translate(flip)
    w = kernels.Words(pa.array([f"{x} {x.translate(flip)} ab ba aab aba baa"], pa.string()))
    assert len(set(w.hash.tolist())) == 7


def test_long_texts_are_read_in_slices():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(60_000)] + ["q" * (3 * kernels.CHUNK), "r"]
    rng.shuffle(words)
    text = "  ".join(words)
    assert len(text.encode()) > 3 * kernels.CHUNK
    w = kernels.Words(pa.array(["x y", text, None, text[:50], ""], pa.string()))
    assert [w.text(k) for k in range(2, 2 + len(words))] == words
    alone = kernels.Words(pa.array(words, pa.string()))
    assert w.hash[2 : 2 + len(words)].tolist() == alone.hash.tolist() and w.doc[:3].tolist() == [0, 0, 1]
