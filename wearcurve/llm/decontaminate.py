"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment over words.

Words are lower-cased (A-Z) and rid of ASCII punctuation. Every 3-word sequence of a benchmark item is a seed, however often it occurs. One pass
over the documents finds the seeds and cuts out the passage around each run of hits on about the same diagonal. A passage whose words could
not give the score asked for even if all that are in the item matched in order is left out (a bound that loses no hit); all others are aligned
with the item (match 2, mismatch -1, gap -1). A hit has at least `similarity` of the score of a full copy, or LONG_MATCH in score.

Benchmarks are taken in blocks of ITEMS_PER_BLOCK items, each against all documents, so what the executors hold is bounded.

Defined results: null or empty texts give no hit; items of fewer than 3 words have no seed and are never found; equal items are found
each; null ids are kept; several rows with one doc_id count as one document (its best alignment with an item is told once).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcurve.llm.kernels import PUNCTUATION, U64, Words, chunks, ngrams

SEED = 3
ITEMS_PER_BLOCK = 20_000
#: Passages that are held and aligned together.
PASSAGES = 8192
SIMILARITY = 0.5
LONG_MATCH = 60
MATCH, MISMATCH, GAP = 2, -1, 1
_FILL_A, _FILL_B = U64(1), U64(2)


class Items:
    """A block of benchmark items: word hashes, and the sorted seeds with their item and place."""

    def __init__(self, rows: list):
        w = Words(pa.array([r["text"] or "" for r in rows], pa.string()), PUNCTUATION)
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        seeds = [ngrams(x, SEED) for x in self.words]
        flat = np.concatenate([np.zeros(0, U64), *seeds])
        item, place = np.repeat(np.arange(len(rows)), [len(s) for s in seeds]), np.concatenate([np.zeros(0, np.int64), *[np.arange(len(s)) for s in seeds]])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.item, self.place = flat[order], item[order], place[order]
        self.lengths = np.array([len(x) for x in self.words])
        self.sets = [np.unique(x) for x in self.words]
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.seeds >> U64(44)).astype(np.int64)] = True


def _passages(w: Words, items: Items, similarity: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, item, first word, words) around each run of hits, of passages with enough words of the item for a hit."""
    grams = ngrams(w.hash, SEED)
    at = np.flatnonzero(items.table[(grams >> U64(44)).astype(np.int64)])
    at = at[w.doc[at] == w.doc[at + SEED - 1]]
    lo, hi = np.searchsorted(items.seeds, grams[at], "left"), np.searchsorted(items.seeds, grams[at], "right")
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    if not len(at):
        return
    pos = np.repeat(at, n)
    k = np.repeat(lo, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
    item, doc, begin = items.item[k], w.doc[pos], pos - items.place[k]
    order = np.lexsort((begin, item, doc))
    pos, k, item, doc, begin = pos[order], k[order], item[order], doc[order], begin[order]
    size = items.lengths[item]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > np.maximum(8, size[1:] // 2))) + 1
    edges = [0, *cut.tolist(), len(pos)]
    for a, b in zip(edges, edges[1:], strict=False):
        d, m = int(doc[a]), int(size[a])
        slack = m // 4 + 4
        first, last = max(int(w.first[d]), int(begin[a]) - slack), min(int(w.first[d + 1]), int(begin[b - 1]) + m + slack)
        words, own = w.hash[first:last], items.sets[int(item[a])]
        shared = own[np.searchsorted(own, words).clip(max=len(own) - 1)] == words
        if MATCH * np.count_nonzero(shared) >= min(similarity * MATCH * m, LONG_MATCH):
            yield d, int(item[a]), first - int(w.first[d]), words


def align(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each x with its y, and the end of the match in y. All pairs advance together, one word of x at a time."""
    m, n = max(map(len, xs)), max(map(len, ys))
    x, y = np.full((len(xs), m), _FILL_A), np.full((len(ys), n), _FILL_B)
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[i, : len(a)], y[i, : len(b)] = a, b
    h, best, end = np.zeros((len(xs), n + 1), np.int32), np.zeros(len(xs), np.int32), np.zeros(len(xs), np.int64)
    ramp = GAP * np.arange(n + 1, dtype=np.int32)
    for i in range(m):
        t = np.zeros_like(h)
        np.maximum(h[:, :-1] + np.where(y == x[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH)), h[:, 1:] - GAP, out=t[:, 1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        top = h.argmax(axis=1)
        score = h[np.arange(len(xs)), top]
        end = np.where(score > best, top, end)
        best = np.maximum(best, score)
    return best, end


def _block(docs: DataFrame, rows: list, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Items(rows))
    ids = [r["item_id"] for r in rows]

    def score(items: Items, item: np.ndarray, first: np.ndarray, words: tuple[np.ndarray, ...]) -> list[tuple[int, int, int, int]]:
        """(place in the passages, score, start, end) of each hit."""
        out = []
        sizes = np.array([len(x) for x in words])
        order = np.argsort(items.lengths[item] * 1000 + sizes, kind="stable")
        a = 0
        while a < len(order):  # as many pairs at once as fit into about 2^21 cells a step
            b = a + max(1, min(512, (1 << 21) // max(1, int(sizes[order[a:]].max()))))
            part = order[a:b]
            xs, ys = [items.words[item[k]] for k in part], [words[k] for k in part]
            best, end = align(xs, ys)
            good = np.flatnonzero((best >= similarity * MATCH * items.lengths[item[part]]) | (best >= LONG_MATCH))
            if len(good):
                _, back = align([xs[g][::-1] for g in good], [ys[g][: end[g]][::-1] for g in good])
                out += [(int(part[g]), int(best[g]), int(first[part[g]] + end[g] - back[k]), int(first[part[g]] + end[g])) for k, g in enumerate(good)]
            a = b
        return out

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            for i, j in chunks(batch.column("text")):
                found = _passages(Words(batch.column("text").slice(i, j - i), PUNCTUATION), items, similarity)
                while part := list(islice(found, PASSAGES)):
                    doc, item, first, words = zip(*part, strict=True)
                    doc, item = np.array(doc), np.array(item)
                    out = score(items, item, np.array(first), words)
                    if out:
                        row, best, start, stop = (np.array(x) for x in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(doc[row])), pa.array([ids[k] for k in item[row]], pa.int64()), pa.array(best, pa.int64()), pa.array(best / (MATCH * items.lengths[item[row]])), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc_id", "item_id", "score", "similarity", "start_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(seek, "doc_id long, item_id long, score long, similarity double, start_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, score, similarity, start_word, end_word (without punctuation, end exclusive): the best alignment of each document with each item found in it."""
    n = benchmark.count()
    b = benchmark.select("item_id", "text").withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-max(n, 1) // ITEMS_PER_BLOCK))))
    out = None
    for k in range(-(-max(n, 1) // ITEMS_PER_BLOCK)):
        part = _block(docs, b.where(F.col("_block") == k).sort("item_id", "text").collect(), similarity)
        out = part if out is None else out.union(part)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), "similarity", "end_word")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.score", "x.similarity", (-F.col("x.s")).alias("start_word"), "x.end_word")
