import random
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import ODD
from wearcurve.llm import packing


def naive(sizes, sources, clusters, capacity, per_source):
    """Best fit by looking at every bin."""
    bins, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(capacity - b["used"], n) for n, b in enumerate(bins) if b["used"] + sizes[k] <= capacity and b["s"][sources[k]] < per_source and (clusters[k] < 0 or clusters[k] not in b["c"])]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"used": 0, "s": Counter(), "c": set()})
        bins[n]["used"] += sizes[k]
        bins[n]["s"][sources[k]] += 1
        bins[n]["c"].add(clusters[k])
        out[k] = n
    return out


@pytest.mark.parametrize("seed", range(5))
def test_kernel_equals_naive_best_fit(seed):
    rng = random.Random(seed)
    n = 300
    sizes = [rng.choice([0, 1, 5, 10, 33, 64, 100]) for _ in range(n)]
    sources = [0 if rng.random() < 0.5 else rng.randrange(1, 6) for _ in range(n)]
    clusters = [0 if rng.random() < 0.3 else rng.choice([-1, -1, rng.randrange(1, 20)]) for _ in range(n)]
    bins, offsets = packing.best_fit(sizes, sources, clusters, 100, 2)
    assert bins == naive(sizes, sources, clusters, 100, 2)
    spans = defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes, strict=True):
        spans[b].append((o, s))
    for v in spans.values():
        v.sort()
        assert all(a + s == c for (a, s), (c, _) in zip(v, v[1:])) and v[0][0] == 0 and v[-1][0] + v[-1][1] <= 100


def test_whole_table(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(["w%d" % rng.randrange(9)] * rng.choice([1, 10, 40, 90, 250]))) for i in range(400)] + [(1000 + k, "copy of one text") for k in range(50)]
    d = docs(rows)
    got = packing.packed(d, capacity=100, rows_per_bucket=120).collect()
    total, source, text = Counter(), {r.doc_id: r.source for r in d.collect()}, dict(rows)
    held = defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_tokens
        held[r.bin_id].append(r)
    assert total == Counter({i: len(t.split()) for i, t in rows})
    for rs in held.values():
        rs.sort(key=lambda r: (r.offset, r.n_tokens))
        assert sum(r.n_tokens for r in rs) <= 100
        assert max(Counter(source[r.doc_id] for r in rs).values()) <= packing.PER_SOURCE
        copies = Counter(text[r.doc_id] for r in rs)
        assert max(copies.values()) == 1
    again = packing.packed(d.repartition(5), capacity=100, rows_per_bucket=120).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_rows_and_empty(spark, docs):
    got = packing.packed(docs(ODD), capacity=4096).collect()
    assert sorted((r.doc_id or 0) for r in got if r.piece == 0) == sorted((i or 0) for i, _ in ODD)
    assert sum(r.n_tokens for r in got if r.doc_id == 5) == 160_000
    assert packing.packed(docs([])).count() == 0


def test_named_sizes_and_clusters(spark):
    d = spark.createDataFrame([(1, "a", "s", 3, 7), (2, "b", None, 3, 7), (3, "c", "s", None, None)], "doc_id long, text string, source string, tokens long, cluster long")
    got = {r.doc_id: r for r in packing.packed(d, capacity=10, size="tokens", cluster="cluster").collect()}
    assert got[1].bin_id != got[2].bin_id and got[3].n_tokens == 0
