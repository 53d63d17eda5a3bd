"""Near-duplicates by MinHash bands and odd sketches, confirmed on full shingle sets.

Texts with equal shingle sets form a class, which one document stands for. Band keys of the classes find
candidates; the odd sketch (a parity bitmap of the MinHash samples, compared by the population count of an XOR)
drops those far from the threshold; the sets of the others are compared in full. Components come from the
confirmed links.

No bucket is expanded into its pairs. First every member is compared with the bucket's rep: the member that shares most band keys with others, as the
original of a group of edited copies does. After that only buckets that still hold several components matter. In waves, members outside the rep's
component (outsiders) are held against others by sizes and sketches (that of the samples and one of the whole set), and what those can't rule out is
confirmed. First they are held against a few members of either kind, whatever the bucket's size, and confirm the closest of each, so
each is dealt once and work and output are linear; components grow with each wave, and outsiders that joined seek no more. The last wave holds those that are left
against all: its comparisons are quadratic in their number, in groups of at most BLOCK and BLOCK, each a task's unit. A wave that holds a
bucket's members all is the last. Every pair of a bucket is so confirmed, ruled out, or joined by other links.

Defined results: null or empty texts, and texts of separators only, have the empty set and link with nothing; a
null doc_id links with nothing, has no component and is kept; rows with the same doc_id are one document,
linked with all that any of its texts is linked with (each row tells the set of its own text); equal rows share a class; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcurve.llm.common import small, stored
from wearcurve.llm.kernels import U64, Words, chunks, mix, shingle_sets

ROWS, BANDS, WORDS64 = 4, 24, 8
SAMPLES, BITS = ROWS * BANDS, WORDS64 * 64
#: Estimates below this are dropped: 5 standard deviations (0.041) under 0.8.
LEAST_ESTIMATE = 0.6
#: Longs of the odd sketch of a whole set, and the standard deviations allowed to it.
FINE64, SIGMAS = 32, 5
BLOCK = 4096
#: Members of a bucket that its outsiders are held against in each wave (about so many of those in the home component, and of the others; in the last, all).
WAVES = (64, None)
_RNG = np.random.default_rng(97)
_A = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.int64).astype(U64)


def most_differing(least: float) -> int:
    """Bits of the XOR of two sketches up to which the similarity is estimated as least or more."""
    differing = 2 * SAMPLES * (1 - least)
    return math.ceil(BITS * (1 - (1 - 2 / BITS) ** differing) / 2)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS) and odd sketches (n x WORDS64) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    mins = np.empty((len(sets), SAMPLES), U64)
    for k in range(SAMPLES):
        mins[:, k] = np.minimum.reduceat((flat ^ _B[k]) * _A[k], at)
    keys = np.zeros((len(sets), BANDS), U64)
    for r in range(ROWS):
        keys = mix(keys ^ mins[:, r::ROWS] + U64(r))
    keys = mix(keys + np.arange(BANDS, dtype=U64))
    bit = mix(mins + np.arange(SAMPLES, dtype=U64) * U64(0x9E3779B97F4A7C15)) % U64(BITS)
    counts = np.zeros((len(sets), BITS), np.uint8)
    np.add.at(counts, (np.arange(len(sets))[:, None], bit.astype(np.int64)), 1)
    return keys, np.packbits(counts & 1, axis=1, bitorder="little").view(U64)


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(shingles ^ U64(0xA0761D6478BD642F)) % U64(FINE64 * 64)).astype(np.int64), minlength=FINE64 * 64)
    return np.packbits((bits & 1).astype(np.uint8), bitorder="little").view(U64)


def may_reach(differing: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `total` members together, whose fine sketches differ in so many bits, may have the similarity.

    At the threshold d = total * (1 - j) / (1 + j) members are in one set only. d members set an odd number of times each bit with
    probability (1 - (1 - 2/n)^d) / 2; mean and variance of the number of such bits follow. A full sketch rules nothing out.
    """
    n, d = FINE64 * 64, total * (100 - percent) / (100 + percent)
    q = (1 - 2 / n) ** d
    mean, variance = n * (1 - q) / 2, (n * (1 - q * q) + n * (n - 1) * ((1 - 4 / n) ** d - q * q)) / 4
    return differing <= mean + SIGMAS * np.sqrt(np.maximum(variance, 0)) + 2


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))


def features(df: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, lo, hi (of the set), keys, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i, j in chunks(texts):
                sets = shingle_sets(Words(texts.slice(i, j - i)), shingle)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys, sketch = np.zeros((len(sets), BANDS), U64), np.zeros((len(sets), WORDS64), U64)
                lo, hi = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
                if len(full):
                    keys[full], sketch[full] = signatures([sets[k] for k in full])
                    flat, at = np.concatenate(sets), np.cumsum([0, *sizes[full][:-1]])
                    lo[full], hi[full] = np.add.reduceat(mix(flat), at), np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), at)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), _arrays(keys), _arrays(sketch)], names=["doc_id", "n_shingles", "lo", "hi", "keys", "sketch"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, lo long, hi long, keys array<long>, sketch array<long>")


def full_sets(df: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, fine, shingles: the sets of the documents named in ids, and their fine sketches, read anew."""
    ids, _ = small(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column("text")):
                sets = shingle_sets(Words(batch.column("text").slice(i, j - i)), shingle)
                values = pa.array(np.concatenate([np.zeros(0, U64), *sets]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), _arrays(np.stack([fine_sketch(x) for x in sets])), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), values)], names=["id", "fine", "shingles"])

    return df.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi").mapInArrow(run, "id long, fine array<long>, shingles array<long>")


def _differing(a: str, b: str):
    return sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(1, WORDS64)), F.bit_count(F.col(f"{a}.sketch")[0].bitwiseXOR(F.col(f"{b}.sketch")[0])))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of those pairs whose full sets reach the threshold."""
    d = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    d = d.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"))
    return d.where(F.expr(f"100 * both >= {percent} * (na + nb - both)")).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every end of an edge, by large and small stars; each round is written to the shared folder."""
    d = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        # large star: every neighbour above u links to the least of u's neighbours and u
        both = d.union(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), "edges")
        # small star: u's lesser neighbours, and u, link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
        d = stored(small_star.select("x.*").where("a <> b").distinct(), "edges")
        # done when every node is either the centre of a star or has a single link to one
        roles = d.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(d.select("b", F.lit(0), F.lit(1)))
        nodes = roles.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if nodes.where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return d.select(F.col("a").alias("id"), F.col("b").alias("component")).union(d.select(F.col("b"), F.col("b")).distinct())


def _roles(rows: DataFrame, wave: int, reps: int | None) -> tuple[DataFrame | None, bool]:
    """rows (key, id, rep, links, component) of the buckets that hold several components, with m (members), outs (those outside the component of the bucket's rep),
    seeks (an outsider) and held (what the outsiders are held against: about `reps` members of either kind and the outsider of most links, or all).
    None without such buckets. Also whether some members were not held."""
    home = F.max(F.when(F.col("id") == F.col("rep"), F.col("component"))).alias("home")
    buckets = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1"), home).where("m > 2 AND c0 <> c1")
    buckets, n = small(stored(buckets.select("key", "m", "home"), "mixed"))
    if not n:
        return None, False
    mixed = stored(rows.join(buckets, "key").withColumn("seeks", F.col("component") != F.col("home")).drop("home"), "members")
    outside = mixed.where("seeks").groupBy("key").agg(F.count("*").alias("outs"), F.max_by("id", F.struct("links", -F.col("id"))).alias("top"))
    d = mixed.join(small(stored(outside, "outside"))[0], "key")
    if reps is None:
        return d.withColumn("held", F.lit(True)), False
    kind = F.when(F.col("seeks"), F.col("outs")).otherwise(F.col("m") - F.col("outs"))
    d = d.withColumn("held", (F.col("id") == F.col("top")) | (F.pmod(F.xxhash64("id", F.lit(wave)), kind) < reps))
    return d.where("seeks OR held"), not d.where("NOT held").isEmpty()


def dealt(roles: DataFrame, block: int = BLOCK) -> DataFrame:
    """roles, dealt to groups (key, part, block): those who seek to their part for every block, those held to their block for every part. In the first waves
    those held are fewer than a block, so everyone who seeks is dealt once."""
    count = lambda n: F.ceil(F.col(n) / block).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), count(n).cast("long")).cast("int")
    sizes = roles.groupBy("key").agg(F.sum(F.col("seeks").cast("long")).alias("seeking"), F.sum(F.col("held").cast("long")).alias("holding")).where("seeking > 0 AND holding > 0")
    d = roles.join(small(stored(sizes, "sizes"))[0], "key")
    names = ["key", "part", "block", "id", "component"]
    seeking = d.where("seeks").withColumn("part", own("seeking")).withColumn("block", every("holding")).select(*names, F.lit(True).alias("asks"))
    return seeking.union(d.where("held").withColumn("block", own("holding")).withColumn("part", every("seeking")).select(*names, F.lit(False)))


def _proposals(roles: DataFrame, sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """a < b: pairs of one who seeks and a member of another component that is held, of those that sizes and both sketches can't rule out: for each the closest, or every one."""
    least = most_differing(LEAST_ESTIMATE)
    d = dealt(roles).join(sets.select("id", "fine", "sketch", "n"), "id").repartition("key", "part", "block").sortWithinPartitions("key", "part", "block")

    def group(t: pa.Table) -> Iterator[np.ndarray]:
        ids, comp, asks, n = (t.column(c).to_numpy() for c in ("id", "component", "asks", "n"))
        fine, coarse = (t.column(c).combine_chunks().flatten().to_numpy().view(U64).reshape(t.num_rows, -1) for c in ("fine", "sketch"))
        members = np.flatnonzero(~asks.astype(bool))
        members = members[np.argsort(n[members], kind="stable")]
        ids_m, comp_m, n_m, fine_m, coarse_m = ids[members], comp[members], n[members], fine[members], coarse[members]
        for u in np.flatnonzero(asks.astype(bool)):
            a, b = np.searchsorted(n_m, -(-n[u] * percent // 100)), np.searchsorted(n_m, n[u] * 100 // percent, "right")
            k = a + np.flatnonzero(comp_m[a:b] != comp[u])
            k = k[np.bitwise_count(coarse_m[k] ^ coarse[u]).sum(axis=1) <= least]
            differing = np.bitwise_count(fine_m[k] ^ fine[u]).sum(axis=1)
            good = may_reach(differing, n_m[k] + n[u], percent)
            k, differing = k[good], differing[good]
            if len(k) and not every:
                k = k[[int(np.lexsort((ids_m[k], differing / (n_m[k] + n[u])))[0])]]
            if len(k):
                yield np.stack([np.minimum(ids_m[k], ids[u]), np.maximum(ids_m[k], ids[u])], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(t: pa.Table, last: bool):
            places = [t.column(c).to_numpy() for c in ("key", "part", "block")]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in places], axis=0)) + 1
            edges = [0, *edges.tolist(), *([t.num_rows] if last else [])]
            found = [pairs for a, b in zip(edges, edges[1:], strict=False) for pairs in group(t.slice(a, b - a))]
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            return t.slice(edges[-1]) if not last else None

        for batch in batches:
            if batch.num_rows:
                rest = yield from cut(pa.Table.from_batches([*held, batch]), False)
                held = rest.to_batches()
        if held:
            yield from cut(pa.Table.from_batches(held), True)

    return d.mapInArrow(run, "a long, b long").distinct()


def _same_id(several: DataFrame, linked: DataFrame, heads: DataFrame) -> DataFrame:
    """a, b: links between the classes of ids that have several."""
    d = linked.join(several, "doc_id", "left_semi").join(heads.select("n_shingles", "lo", "hi", "id"), ["n_shingles", "lo", "hi"]).select("doc_id", "id").distinct()
    return d.join(d.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of df (doc_id, text)."""
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = stored(features(df, shingle), "features")
    linked = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    heads = stored(linked.groupBy("n_shingles", "lo", "hi").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "heads")
    rows = heads.select("id", F.explode("keys").alias("key"))
    shared = stored(rows.join(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"), "shared")
    shared = shared.join(shared.groupBy("id").agg(F.sum("m").alias("links")), "id")
    shared = stored(shared, "ranked")
    reps = shared.groupBy("key").agg(F.max_by("id", F.struct("links", -F.col("id"))).alias("rep"))
    shared = stored(shared.join(reps, "key"), "buckets")
    sketches = heads.select("id", "sketch")
    pairs = shared.where("id <> rep").select(F.least("rep", "id").alias("a"), F.greatest("rep", "id").alias("b")).distinct()
    near = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch")).alias("x"), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch")).alias("y"), "b")
    tested = stored(near.where(_differing("x", "y") <= most_differing(LEAST_ESTIMATE)).select("a", "b"), "pairs")
    wide = shared.where("m > 2").select("key", "id", "rep", "links")
    ids = stored(tested.select(F.explode(F.array("a", "b")).alias("id")).union(wide.select("id")).distinct(), "ids")
    each = F.struct("n_shingles", "lo", "hi")
    repeated = stored(linked.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(each).alias("x"), F.max(each).alias("y")).where("n > 1").select("doc_id", (F.col("x") != F.col("y")).alias("differ")), "repeated")
    again = not repeated.isEmpty()
    sets = stored(full_sets(df.dropDuplicates(["doc_id", "text"]) if again else df, ids, shingle), "sets")
    edges = confirmed(tested, sets, percent)
    if again:
        edges = edges.union(_same_id(repeated.where("differ"), linked, heads))
    labels = stored(components(stored(edges, "links")), "labels")
    drawn = sets.select("id", "fine", F.size("shingles").cast("long").alias("n")).join(sketches, "id")
    more = True
    for wave, reps in enumerate(WAVES):
        if not more:
            break
        at = wide.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        roles, more = _roles(at, wave, reps)
        if roles is None:
            break
        pairs = stored(_proposals(roles, drawn, percent, not more).join(tested, ["a", "b"], "left_anti"), "pairs")
        links = None if pairs.isEmpty() else stored(confirmed(pairs, sets, percent), "links")
        if links is not None and not links.isEmpty():
            labels = stored(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links)), "labels")
        tested = tested.union(pairs)
    named = stored(heads.select("n_shingles", "lo", "hi", "id").join(labels, "id", "left").select("n_shingles", "lo", "hi", F.coalesce("component", "id").alias("component")), "named")
    d = seen.select("doc_id", "n_shingles", "lo", "hi").join(named, ["n_shingles", "lo", "hi"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return d.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
