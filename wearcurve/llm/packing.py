"""Best-fit packing of documents into sequences of a fixed number of tokens, under conflicts.

Documents are dealt by hash into buckets of about ROWS_PER_BUCKET pieces, so a task's memory is bounded and a hot source or
duplicate cluster is spread evenly. Within a bucket, pieces come by falling size; the open bins are ordered by
what is left in them, and the successor search starts at the tightest that fits and goes on until one is compatible.
A bin carries bitmaps: one of its duplicate clusters (no two pieces of a cluster meet) and `per_source` of its sources (the
k-th is set for a source that it holds k times; when all are set, the source is refused).

Tokens are words (runs without space or 0x09 to 0x0D) unless a column of sizes is named. A document longer than the capacity is cut
into pieces of full capacity and a rest. Clusters are equal texts unless a column is named.

Defined results: null or empty texts have size 0 and are placed like others; a null text, or a null cluster, is in no
cluster; a null source is a source of its own; rows with equal doc_id are placed each.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcurve.llm.common import WORD, stored

CAPACITY = 4096
PER_SOURCE = 4
ROWS_PER_BUCKET = 4096
#: Bins of a bucket are numbered below this.
BINS = 1 << 20


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each piece. sources and clusters are small ints; -1 is no cluster."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    left: list[tuple[int, int]] = []  # (residual, bin), ordered
    planes: list[list[int]] = []
    seen: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, s, c = sizes[k], 1 << sources[k], 1 << clusters[k] if clusters[k] >= 0 else 0
        i = bisect_left(left, (size, -1))
        while i < len(left) and (seen[left[i][1]] & c or planes[left[i][1]][-1] & s):
            i += 1
        if i < len(left):
            rest, b = left.pop(i)
        else:
            rest, b = capacity, len(planes)
            planes.append([0] * per_source)
            seen.append(0)
        for p, held in enumerate(planes[b]):
            if not held & s:
                planes[b][p] = held | s
                break
        seen[b] |= c
        bins[k], offsets[k] = b, capacity - rest
        insort(left, (rest - size, b))
    return bins, offsets


def packed(df: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, size: str | None = None, cluster: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, piece, n_tokens, first_token (of the piece in its document), bin_id, offset (of the piece in its bin)."""
    d = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        (F.col(size) if size else F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))).cast("long").alias("_n"),
        (F.xxhash64(cluster) if cluster else F.xxhash64("text")).alias("_c"),
        (F.col(cluster) if cluster else F.col("text")).isNull().alias("_alone"),
    ).withColumn("_n", F.coalesce("_n", F.lit(0)))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int"))
    d = d.select("*", F.explode(pieces).alias("piece")).select(
        "doc_id", "source", F.when(~F.col("_alone"), F.col("_c")).alias("cluster"), "piece", F.least(F.col("_n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).alias("n_tokens"), F.xxhash64("doc_id", "piece", "_c").alias("_h")
    )
    d = stored(d, "pieces")
    n = max(1, math.ceil(d.count() / rows_per_bucket))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        names = {s: i for i, s in enumerate(dict.fromkeys(t.column("source").to_pylist()))}
        clusters = t.column("cluster").to_pylist()
        again = {c: i for i, c in enumerate(c for c, m in Counter(clusters).items() if m > 1 and c is not None)}
        bins, offsets = best_fit(t.column("n_tokens").to_pylist(), [names[s] for s in t.column("source").to_pylist()], [again.get(c, -1) for c in clusters], capacity, per_source)
        bucket = t.column("bucket")[0].as_py()
        first = np.array(t.column("piece").to_pylist(), np.int64) * capacity
        return pa.table([t.column("doc_id"), t.column("piece"), t.column("n_tokens"), pa.array(first), pa.array([bucket * BINS + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())], names=["doc_id", "piece", "n_tokens", "first_token", "bin_id", "offset"])

    d = d.withColumn("bucket", F.pmod("_h", F.lit(n).cast("long"))).drop("_h")
    return d.groupBy("bucket").applyInArrow(place, "doc_id long, piece int, n_tokens long, first_token long, bin_id long, offset long")
