"""Bearing parameters from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearcurve import functions as fn
from wearcurve.kernels import ratings

#: The bearings that are looked for, with maker, type and rating by their makers, and makers' file names.
BEARINGS = [("6205", "SKF", "ball", 14.8, 25.0), ("6204", "SKF", "ball", 13.5, 20.0), ("ZA-2115", "Rexnord", "roller", 90.3, 49.2), ("UER204", "LDK", "ball", 12.0, 20.0)]
SOURCES = {"SKF": ["skf"], "REXNORD": ["rexnord", "catalogo"], "LDK": ["ldk", "mounted"]}
PARAMS = "designation string, manufacturer string, bore_mm double, c_kn double, c0_kn double, life_exponent double, bearing_type string, n_balls_or_rollers int, pitch_diameter_mm double, ball_or_roller_diameter_mm double, contact_angle_deg double, source_file string, source_page bigint, extraction_confidence string, raw_text string"


def bearings(spark) -> DataFrame:
    return spark.createDataFrame(BEARINGS, "designation string, manufacturer string, bearing_type string, known_c_kn double, known_bore_mm double")


def queries(wanted: DataFrame) -> DataFrame:
    d, m = F.col("designation"), F.col("manufacturer")
    qs = F.array(F.concat(d, F.lit(" specifications")), F.trim(F.concat(m, F.lit(" "), d, F.lit(" load rating"))), F.concat(d, F.lit(" dimensions")), F.concat(d, F.lit(" dynamic load")))
    return wanted.select("designation", F.posexplode(qs).alias("k", "query"))


def merged_neighbours(chunks: DataFrame, reach: int = 2) -> DataFrame:
    """chunks + merged: the text with those of up to 2 chunks on either side on its page."""
    w = Window.partitionBy("source", "page").orderBy("chunk_no").rowsBetween(-reach, reach)
    return chunks.withColumn("merged", F.array_join(F.collect_list("text").over(w), "\n"))


def of_maker(hits: DataFrame) -> DataFrame:
    """Only chunks from the maker's own files, for designations that have any."""
    own = F.lit(False)
    for m, names in SOURCES.items():
        for n in names:
            own = own | ((F.upper("manufacturer") == m) & F.contains(F.lower("source"), F.lit(n)))
    told = hits.withColumn("_own", own)
    chosen = told.groupBy("designation").agg(F.max("_own").alias("_any"))  # a row a designation; hits of a common one aren't dealt to one task
    return told.join(chosen, "designation").where("_own OR NOT _any").drop("_own", "_any")


def rated(hits: DataFrame, use_known: bool = False) -> DataFrame:
    """hits (designation, manufacturer, known_c_kn, source, page, chunk_id, merged) with ratings found: + c_kn, c0_kn, found_bore_mm, code_bore_mm (by the designation)."""
    names = ["designation", "manufacturer", "bearing_type", "known_c_kn", "known_bore_mm", "source", "page", "chunk_id", "merged", "code_bore_mm"]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text, d, m, known in zip(pdf["merged"], pdf["designation"], pdf["manufacturer"], pdf["known_c_kn"], strict=True):
                r = ratings.from_table(text or "", d, m, known if use_known and known == known else None) or ratings.from_prose(text or "")
                rows.append((r.get("c_kn"), r.get("c0_kn"), r.get("bore_mm")))
            yield pd.concat([pdf, pd.DataFrame(rows, columns=["c_kn", "c0_kn", "found_bore_mm"], index=pdf.index, dtype=float)], axis=1)

    d = hits.withColumn("code_bore_mm", fn.bore_mm(F.col("designation"))).select(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) + ", c_kn double, c0_kn double, found_bore_mm double"
    return d.mapInPandas(run, schema).where("c_kn IS NOT NULL AND NOT isnan(c_kn)").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("c0_kn", "found_bore_mm")})


def tier(c: str = "c_kn", known: str = "known_c_kn"):
    error = F.abs(F.col(c) - F.col(known)) / F.col(known)
    return F.when(F.col(c).isNull(), "fallback").when(F.col(known).isNull(), "medium").when(error < 0.02, "high").when(error < 0.10, "medium").when(error < 0.35, "low").otherwise("fallback")


def extract(wanted: DataFrame, hits: DataFrame, use_known: bool = False) -> DataFrame:
    """A row of PARAMS for each wanted bearing. Of several plausible candidates the first by chunk_id counts (use_known: that closest to the known rating, as long as one is given)."""
    found = rated(of_maker(hits), use_known).withColumn("bore_mm", F.coalesce("found_bore_mm", "code_bore_mm"))
    found = found.where(fn.plausible(F.col("bore_mm"), F.col("c_kn"), F.col("bearing_type")))
    order = F.struct(F.when(F.lit(use_known), F.abs(F.col("c_kn") - F.col("known_c_kn"))).otherwise(F.lit(0.0)), F.col("chunk_id"))
    best = found.groupBy("designation").agg(F.min_by(F.struct("c_kn", "c0_kn", "bore_mm", "source", "page", "merged"), order).alias("x")).select("designation", "x.*")
    d = wanted.join(best, "designation", "left").withColumn("extraction_confidence", tier())
    lost = F.col("extraction_confidence") == "fallback"
    none = lambda kind: F.lit(None).cast(kind)
    return d.select(
        "designation", "manufacturer",
        F.when(lost, F.coalesce("known_bore_mm", fn.bore_mm(F.col("designation")), F.lit(0.0))).otherwise(F.col("bore_mm")).alias("bore_mm"),
        F.when(lost, F.coalesce("known_c_kn", F.lit(0.0))).otherwise(F.col("c_kn")).alias("c_kn"),
        F.when(~lost, F.col("c0_kn")).alias("c0_kn"),
        F.when(F.col("bearing_type") == "ball", 3.0).otherwise(10.0 / 3.0).alias("life_exponent"), "bearing_type",
        none("int").alias("n_balls_or_rollers"), none("double").alias("pitch_diameter_mm"), none("double").alias("ball_or_roller_diameter_mm"), none("double").alias("contact_angle_deg"),
        F.when(~lost, F.col("source")).when(F.col("known_c_kn").isNotNull(), "ground_truth").otherwise("none").alias("source_file"),
        F.when(~lost, F.col("page")).cast("bigint").alias("source_page"), "extraction_confidence", F.when(~lost, F.substring("merged", 1, 500)).otherwise(F.lit("")).alias("raw_text"),
    )


def prose_ratings(text: str = "text"):
    """c_kn and c0_kn columns: the first pattern that gives a plausible number, with each pattern's first match."""

    def value(pattern: str):
        v = F.nullif(F.regexp_extract(F.col(text), "(?i)" + pattern, 1), F.lit("")).cast("double")
        return F.when((v > 0.5) & (v < 2000), v)

    return {k: F.coalesce(*[value(p) for p in ps]) for k, ps in ratings.PROSE.items()}


def report(params: DataFrame, wanted: DataFrame) -> DataFrame:
    """designation, line: a line of text on each bearing."""
    d = params.join(wanted.select("designation", "known_c_kn"), "designation")
    error = F.when(F.col("known_c_kn").isNotNull() & (F.col("c_kn") > 0), F.format_string(" (error: %.1f%%)", F.abs(F.col("c_kn") - F.col("known_c_kn")) / F.col("known_c_kn") * 100)).otherwise("")
    return d.select("designation", F.concat(F.format_string("%s (%s): bore %.1f mm, C %.2f kN, confidence %s", "designation", "manufacturer", "bore_mm", "c_kn", "extraction_confidence"), error).alias("line"))


def run(chunks: DataFrame, wanted: DataFrame | None = None, k: int = 15, use_known: bool = False, encode=None) -> DataFrame:
    """PARAMS of the wanted bearings from a table of chunks: four queries each, hits once, neighbours merged, rated, chosen."""
    from wearcurve.operators.retrieval import retrieve

    wanted = bearings(chunks.sparkSession) if wanted is None else wanted
    q = queries(wanted).select("designation", F.struct("designation", "k").alias("query_id"), "query")
    hits = retrieve(q.select("query_id", "query"), chunks, k, encode).select(F.col("query_id.designation").alias("designation"), "chunk_id").distinct()
    return extract(wanted, hits.join(merged_neighbours(chunks), "chunk_id").join(wanted, "designation"), use_known)
