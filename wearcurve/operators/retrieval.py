"""Vector and keyword retrieval of chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcurve import functions as fn

#: Makers of known designations, and prefixes that scans confuse.
KNOWN = {"6205": "SKF", "6205-2RS": "SKF", "6204": "SKF", "6204-2RS": "SKF", "ZA-2115": "Rexnord", "ZA2115": "Rexnord", "UER204": "LDK"}
QUERY_BLOCK = 4096
#: Scores that a task computes at once.
SCORES = 4_000_000
CONFUSED = {"UER": ["VER", "UFR", "UBR"]}
#: What a text that holds ratings shows, and what it is worth (the first that holds): thousands set off by a comma or a number in kilonewtons; else a number of 4 to 6 digits.
SIGNS = [([r"[0-9],[0-9]{3}", *(rf"[0-9][.]?\s*{unit}" for unit in ("kN", "KN", "kn"))], 0.1), ([r"\b[0-9]{4,6}\b"], 0.05)]


def knn(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "query_id", vid: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """qid, vid, score: the k most similar vectors of each query by cosine (to 9 decimals), exactly; the smaller id of equals. A vector of zeros is worth 0, null vectors take no part.

    Queries are taken in blocks of about QUERY_BLOCK, whatever their number, which every task gets as one matrix; each batch of vectors is multiplied by it and
    sends on its own k best a query, which the row number cuts again below its shuffle.
    """
    spark = queries.sparkSession
    asked = queries.where(F.col(vec).isNotNull()).select(qid, F.col(vec).cast("array<double>").alias("_v"))
    given = vectors.where(F.col(vec).isNotNull()).select(vid, F.col(vec).cast("array<double>").alias("_v"))
    schema = T.StructType([T.StructField("_q", T.IntegerType()), given.schema[vid], T.StructField("score", T.DoubleType())])
    blocks = -(-max(asked.count(), 1) // QUERY_BLOCK)
    w = Window.partitionBy(qid).orderBy(F.desc("score"), vid)
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b).collect()
        names = spark.createDataFrame([(r[0], i) for i, r in enumerate(block)], T.StructType([asked.schema[qid], T.StructField("_q", T.IntegerType())]))
        scored = given.mapInArrow(_nearest(spark.sparkContext.broadcast(np.array([r[1] for r in block], float)), k, vid), schema)
        part = scored.join(F.broadcast(names), "_q").select(qid, vid, "score").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
        out = part if out is None else out.unionByName(part)
    return out


def _nearest(asked, k: int, vid: str):
    """Arrow batches of vid and _v to _q (row of the matrix asked), vid and score of the k best in each batch."""
    cells = SCORES

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(size > 0, size, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        if not len(q):
            return
        q = unit(q)
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, cells // len(q))):
                part = batch.slice(at, max(1, cells // len(q)))
                part = part.sort_by(vid)  # so that the first of equals has the smallest id
                m = unit(part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                score = np.round(q @ m.T, 9) + 0.0
                if part.num_rows > k:
                    least = np.partition(score, part.num_rows - k, axis=1)[:, [part.num_rows - k]]
                    above, equal = score > least, score == least
                    row, col = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))))
                else:
                    row, col = (x.ravel() for x in np.indices(score.shape))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), part.column(vid).take(pa.array(col)), pa.array(score[row, col])], names=["_q", vid, "score"])

    return run


def search_terms(d: Column) -> Column:
    """Spellings under which a designation is looked for."""
    up = F.upper(d)
    base, core = F.regexp_replace(up, "-2RS$", ""), F.regexp_replace(up, "^[A-Z]{1,3}-?", "")
    more = [F.when(F.startswith(up, F.lit(p)), F.concat(F.lit(v), F.substring(up, len(p) + 1, 99))) for p, vs in CONFUSED.items() for v in vs]
    return F.array_distinct(F.array_compact(F.array(up, base, F.when(F.length(core) >= 3, core), *more)))


def expanded_queries(queries: DataFrame) -> DataFrame:
    """query_id, query: each query, and two more where it names a designation."""
    d = fn.designation(F.col("query"))
    maker = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv]), F.upper(d)), F.lit(""))
    more = F.array(F.col("query"), F.concat(d, F.lit(" specifications dimensions load rating")), F.trim(F.concat(maker, F.lit(" "), d, F.lit(" bearing"))))
    return queries.select("query_id", F.explode(F.when(d.isNotNull(), more).otherwise(F.array("query"))).alias("query"))


def hybrid(queries: DataFrame, candidates: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_id, text, score: the best k chunks of each query (query_id, query).

    candidates (query_id, chunk_id, score) come from vector searches; the best score of a chunk counts. Chunks that hold a spelling of the query's
    designation join in with 0.85 at least; the designation itself is worth 1.3 times (to 1 at most), load ratings 0.1, other large numbers 0.05.
    """
    q = queries.select("query_id", fn.designation(F.col("query")).alias("_d")).withColumn("_terms", search_terms(F.col("_d")))
    named = q.where(F.col("_d").isNotNull())
    up = F.upper("text")
    scan = chunks.join(named, F.exists("_terms", lambda x: F.contains(up, x))).select("query_id", "chunk_id", F.lit(0.85).alias("score"))
    best = candidates.select("query_id", "chunk_id", "score").unionByName(scan).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    d = best.join(chunks.select("chunk_id", "text"), "chunk_id").join(q, "query_id")
    du = F.upper("_d")
    holds = F.contains(up, du) | F.contains(up, F.regexp_replace(du, "-2RS$", ""))
    score = F.when(holds, F.least(F.col("score") * 1.3, F.lit(1.0))).otherwise(F.col("score"))
    extra = F.lit(0.0)
    for signs, worth in reversed(SIGNS):
        extra = F.when(reduce(or_, [F.col("text").rlike(x) for x in signs]), worth).otherwise(extra)
    d = d.withColumn("score", F.when(F.col("_d").isNotNull(), score + extra).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("query_id", "chunk_id", "text", F.round("score", 9).alias("score"))


def dedup_max(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    return hits.groupBy(key).agg(F.max("score").alias("score"))


def hashed_vector(text: Column, size: int = 256) -> Column:
    """Counts of the text's words in `size` hashed places: a stand-in where no embedding model is at hand."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int"))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(own, lambda p: p == k)).cast("double"))
    return F.get(F.transform(F.array(places), counts), F.lit(0))  # the places are computed once


def embed(df: DataFrame, key: str, text: str = "text", encode=None) -> DataFrame:
    """key, embedding. encode(list of texts) -> vectors is loaded once a task and fed batch by batch; without it words are hashed."""
    if encode is None:
        return df.select(key, hashed_vector(F.col(text)).alias("embedding"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": [[float(x) for x in v] for v in encode(pdf[text].tolist())]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 5, encode=None) -> DataFrame:
    """query_id, chunk_id, text, score: 3k candidates of each query and of its expansions by vectors, then the hybrid ranking."""
    q = expanded_queries(queries).select("query_id", "query", F.struct("query_id", "query").alias("qid"))
    hits = knn(embed(q, "qid", "query", encode), embed(chunks, "chunk_id", "text", encode), 3 * k, "qid", "chunk_id")
    return hybrid(queries, hits.select(F.col("qid.query_id").alias("query_id"), "chunk_id", "score"), chunks, k)
