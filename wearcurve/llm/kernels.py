"""Vectorised text kernels (NumPy over the UTF-8 bytes of an Arrow batch)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step takes (a longer text is a step of its own).
CHUNK = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit values (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of each (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of about limit bytes together."""
    _, offs = raw(texts)
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


#: ASCII bytes that are neither letters nor digits, for words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Words:
    """Words (maximal runs without space or 0x09 to 0x0D) of several texts, A-Z lower-cased unless lower is false.

    A word's hash sums a mixed 64-bit value of each of its bytes and their places, so it has no weak words as polynomials modulo 2^64 have. Texts are
    read in slices, so beside the words (about 4 bytes for each byte of text) the memory is that of a slice.
    """

    def __init__(self, texts: pa.Array, drop: np.ndarray | None = None, lower: bool = True):
        """drop: a table of 256 booleans, of bytes that separate words as well."""
        body, self.offsets = raw(texts)
        self.n_docs = len(self.offsets) - 1
        sep = _SEP if drop is None else _SEP | drop
        self.body = body = _LOWER[body] if lower else body
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(body))]
        parts = [_slice(body, p, q, sep, inner) for p, q in _slices(body, sep, self.offsets)]
        kind = np.int32 if len(body) < 1 << 31 else np.int64
        self.starts, self.ends, self.hash = (np.concatenate([np.zeros(0, t), *[x[k] for x in parts]]).astype(t, copy=False) for k, t in enumerate((kind, kind, U64)))
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, its first word

    @cached_property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def text(self, k: int) -> str:
        return self.body[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def _slices(body: np.ndarray, sep: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end before a separator or with a text."""
    at, n = 0, len(body)
    while at < n:
        stop, look = min(at + CHUNK, n), 1 << 12
        edge = int(offsets[np.searchsorted(offsets, stop)])
        while stop < edge:
            cut = np.flatnonzero(sep[body[stop : min(stop + look, edge)]])
            if len(cut):
                stop += int(cut[0])
                break
            stop, look = min(stop + look, edge), 2 * look
        yield at, stop
        at = stop


def _slice(body: np.ndarray, p: int, q: int, sep: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in body[p:q], which begins and ends at edges of words."""
    part, n = body[p:q], q - p
    solid = ~sep[part]
    cuts = inner[np.searchsorted(inner, p, "right") : np.searchsorted(inner, q)] - p  # texts that begin inside
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    value = (np.arange(n) - begin).astype(U64)
    value <<= U64(8)
    value |= part
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(value * U64(0x9E3779B97F4A7C15) + U64(0xD1B54A32D192ED03)), out=sums[1:])
    return starts + p, ends + p, mix(sums[ends] - sums[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_STEP = [U64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _STEP[k % len(_STEP)]
        out ^= out >> U64(29)
    return mix(out)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence; without words, none."""
    every, out = ngrams(w.hash, n), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(ngrams(w.hash[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out
