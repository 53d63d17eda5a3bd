"""Quality classifier: supervised subword embeddings with a softmax output, trained by NumPy stochastic gradient descent.

A document is the mean of the vectors of its features, which are hashed into BUCKETS: its words, its pairs of adjacent
words (pairs of equal words share one vector, since a pair seen only once teaches nothing), and the runs of 1 to 4 characters (code points) within words. Two output vectors and a
bias make the softmax. The model is linear in the mean, so a feature's part of the score is one number, and scoring looks up one number per feature.

Training takes at most TRAIN_ROWS labelled documents, those with the smallest hashes of their ids, and of these, in that order, as many as hold TRAIN_BYTES
together (the documented bounds of the sample); scoring takes every text whole. Labels are read only where crc32(doc_id as text) mod 4 is not 2.

Defined results: null or empty texts have no features and get the score of the bias; a null doc_id is never held out and has no
label; of several labels of one id the least counts, of several texts of one id the least is learnt from; without labels of both classes the score is their share (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearcurve.llm.kernels import U64, Words, chunks, ngrams

BITS, DIM = 17, 16
BUCKETS = 1 << BITS
TRAIN_ROWS, TRAIN_BYTES = 4096, 64 << 20
#: Steps are taken over EPOCHS at least, and until there were LEAST_STEPS.
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 768, 32, 4.0
THRESHOLD = 0.7
CHARS = (1, 2, 3, 4)
_SHIFT, _SHIFT32 = U64(64 - BITS), np.uint32(32 - BITS)
_EQUAL = U64(0x5BD1E9955BD1E995)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (bucket, text), one after another for each kind of feature; texts ascend within a kind."""
    w = Words(texts, lower=False)
    if not len(w.hash):
        return
    yield (w.hash >> _SHIFT).astype(np.int32), w.doc
    same = w.doc[1:] == w.doc[:-1]
    pairs = np.where(w.hash[1:] == w.hash[:-1], _EQUAL, ngrams(w.hash, 2))
    yield (pairs[same] >> _SHIFT).astype(np.int32), w.doc[1:][same]
    first = np.flatnonzero((w.body & 0xC0) != 0x80)  # of each character, its first byte
    word = np.searchsorted(w.starts, first, "right") - 1
    inside = (word >= 0) & (first < w.ends[word])
    first, word = first[inside], word[inside]
    tail = np.concatenate([w.body, np.zeros(3, np.uint8)])
    char = w.body[first].astype(np.uint32)
    for k in (1, 2, 3):
        wide = np.flatnonzero(char >= (0x80 if k == 1 else 0x1000 if k == 2 else 0x100000))  # characters so far of k bytes at least
        more = tail[first[wide] + k]
        wide = wide[(more & 0xC0) == 0x80]
        char[wide] = (char[wide] << np.uint32(8)) | tail[first[wide] + k]
    left = np.searchsorted(first, w.ends)[word] - np.arange(len(first))  # characters of the word from here on
    doc = w.doc[word]
    code = np.zeros(len(first), np.uint32)
    for k in range(min(max(CHARS), len(first))):
        at = code[: len(first) - k]
        at *= np.uint32(0x01000193)
        at ^= mixed32(char[k:])
        if k + 1 in CHARS:
            ok = np.flatnonzero(left[: len(first) - k] > k)
            yield (((code[ok] + np.uint32(k)) * np.uint32(0x9E3779B1)) >> _SHIFT32).astype(np.int32), doc[ok]


def mixed32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return x ^ (x >> np.uint32(12))


class Model:
    """score = sigmoid(mean of parts[feature] + bias)"""

    def __init__(self, parts: np.ndarray, bias: float):
        self.parts, self.bias = parts, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for f, doc in _features(texts):
            total += np.bincount(doc, self.parts[f], len(texts))
            count += np.bincount(doc, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    docs = []
    for t in texts:
        every = [f for f, _ in _features(pa.array([t or ""]))]
        ids, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.int64), np.zeros(0))
        docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM), np.float32) - np.float32(0.5)) / DIM).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))  # both classes count alike
    each = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            rate, step = RATE * (1 - step / steps), step + 1
            part = order[a : a + BATCH]
            means = np.stack([docs[k][1] @ vectors[docs[k][0]] for k in part])
            z = means @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= (weight[y[part]] / len(part))[:, None]
            back = (p @ out).astype(np.float32)
            out -= (rate * p.T @ means).astype(np.float32)
            bias -= (rate * 0.1 * p.sum(axis=0)).astype(np.float32)
            for k, g in zip(part, back, strict=True):
                vectors[docs[k][0]] -= np.float32(rate) * docs[k][1][:, None] * g
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """Trained on at most `rows` labelled documents of at most `size` bytes together (one at least)."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample only
    got = got.withColumn("_bytes", so_far).where((F.col("_bytes") <= size) | (F.col("_bytes") == F.octet_length("text"))).orderBy("doc_id").toArrow()
    return train(got.column("text").to_pylist(), got.column("quality").to_pylist())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(held.value.score(batch.column("text").slice(i, j - i)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
