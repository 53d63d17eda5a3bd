"""Queries over documents, embeddings and the catalog fixture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wearcurve import functions as fn
from wearcurve.kernels import ratings
from wearcurve.operators import extraction, retrieval, text
from wearcurve.plans import chunk_sql, fixtures
from wearcurve.plans.registry import query
from wearcurve.plans.views import table

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLEAN = f"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[^\\S\\n]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), chr(10)), '^\\s+|\\s+$', '', 'g')"


def pages(spark, d):
    """Documents as pages: the source's documents in order of their ids."""
    w = Window.partitionBy("source").orderBy("doc_id")
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    numbers = docs.select("doc_id", F.row_number().over(w).cast("long").alias("page"))  # texts aren't dealt by source
    return docs.join(numbers, "doc_id").select("source", "page", "doc_id", "text")


_PAGES = "pg AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, doc_id, text FROM documents)"


@query("clean_text", f"SELECT doc_id, md5({_CLEAN}) AS cleaned, length({_CLEAN}) AS n FROM documents")
def clean_text(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.col("t").cast("binary")).alias("cleaned"), F.length("t").alias("n"))


@query(
    "repeated_lines",
    f"WITH l AS (SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ls FROM documents), "
    "e AS (SELECT source, unnest(list_distinct(list_concat(ls[1:2], ls[-2:]))) AS line FROM l), c AS (SELECT source, count(*) AS pages FROM documents GROUP BY source) "
    "SELECT source, line, count(*) AS n_pages FROM e JOIN c USING (source) WHERE length(line) < 200 AND pages >= 4 GROUP BY source, line, pages HAVING count(*) >= 0.05e0 * pages",
)
def repeated_lines(spark, d):
    return text.repeated_lines(table(spark, d, "documents"), share=0.05)


_LN = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '')"
_TABLE_ROWS = f"len(list_filter({_LN}, lambda x: regexp_matches(x, '^[\\p{{L}}\\p{{N}}_\\-/]+\\s+[\\d.]+(?:\\s+[\\d.]+){{2,}}')))"
_DIGITS = "(length(text) - length(regexp_replace(text, '\\d', '', 'g')))"
_SOLID = "length(regexp_replace(text, '\\s', '', 'g'))"
_KIND = f"CASE WHEN {_SOLID} = 0 THEN 'mixed' WHEN ({_DIGITS} / {_SOLID} > 0.4e0 AND {_TABLE_ROWS} / greatest(len({_LN}), 1) > 0.3e0) OR {_DIGITS} / {_SOLID} > 0.5e0 OR {_TABLE_ROWS} / greatest(len({_LN}), 1) > 0.5e0 THEN 'table' ELSE 'prose' END"


@query("content_type", f"SELECT 'd' || doc_id AS id, {_KIND} AS kind FROM documents UNION ALL SELECT chunk_id, {_KIND} FROM (WITH {fixtures.CATALOG_SQL} SELECT * FROM cat)")
def content_type(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return docs.union(fixtures.catalog(spark, d).select("chunk_id", "text")).select("id", text.content_type(F.col("text")).alias("kind"))


@query("line_table_stats", f"SELECT doc_id, len({_LN}) AS n_lines, {_TABLE_ROWS} AS n_table_lines, round({_DIGITS} / greatest(1, {_SOLID}), 6) AS digit_share FROM documents")
def line_table_stats(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n", -1), text.strip), lambda x: x != "")
    digits = F.length("text") - F.length(F.regexp_replace("text", r"\d", ""))
    return table(spark, d, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: x.rlike(text.TABLE_LINE))).alias("n_table_lines"), (digits / F.greatest(F.lit(1), F.length(F.regexp_replace("text", r"\s", "")))).alias("digit_share"))


_HEADER = f"coalesce(list_filter({_LN}, lambda x: regexp_full_match(x, '(?:\\d+(?:\\.\\d+)*\\s+\\S.*|[A-Z][A-Z\\s]{{4,}})'))[1][1:120], '')"


@query("section_header_carry", f"WITH {_PAGES}, h AS (SELECT source, page, nullif({_HEADER}, '') AS h FROM pg) SELECT source, page, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY source ORDER BY page), '') AS section_header FROM h")
def section_header_carry(spark, d):
    return text.carried_header(pages(spark, d)).select("source", "page", "section_header")


@query("manufacturer_tag", f"WITH {fixtures.CATALOG_SQL}, f AS (SELECT source, min_by(text, page) AS t FROM cat WHERE chunk_no = 0 GROUP BY source) SELECT source, CASE WHEN contains(upper(source || ' ' || t), 'SKF') THEN 'SKF' WHEN contains(upper(source || ' ' || t), 'REXNORD') THEN 'Rexnord' WHEN contains(upper(source || ' ' || t), 'LDK') THEN 'LDK' ELSE 'Unknown' END AS manufacturer FROM f")
def manufacturer_tag(spark, d):
    first = fixtures.catalog(spark, d).where("chunk_no = 0").groupBy("source").agg(F.min_by("text", "page").alias("t"))
    return first.select("source", text.maker(F.col("source"), F.col("t")).alias("manufacturer"))


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query("chunk_words", f"WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), k AS (SELECT doc_id, ws, unnest(range((len(ws) - 1) // 200 + 1)) AS chunk_no FROM w WHERE len(ws) > 0) SELECT doc_id, chunk_no, md5(array_to_string(ws[chunk_no * 200 + 1 : chunk_no * 200 + 200], ' ')) AS chunk FROM k")
def chunk_words(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(text.word_blocks(F.col("text"), 200)).alias("chunk_no", "c"))
    return c.select("doc_id", "chunk_no", F.md5(F.col("c").cast("binary")).alias("chunk"))


@query(
    "chunk_table_rows",
    f"WITH w AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_WS}) <> '') AS ls FROM documents), k AS (SELECT doc_id, ls, unnest(range(greatest(1, (len(ls) - 2) // 3 + 1))) AS chunk_no FROM w WHERE len(ls) > 0) "
    "SELECT doc_id, chunk_no, md5(CASE WHEN len(ls) = 1 THEN ls[1] ELSE ls[1] || chr(10) || array_to_string(ls[chunk_no * 3 + 2 : chunk_no * 3 + 4], chr(10)) END) AS chunk FROM k",
)
def chunk_table_rows(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(text.table_rows(F.col("text"), 3)).alias("chunk_no", "c"))
    return c.select("doc_id", "chunk_no", F.md5(F.col("c").cast("binary")).alias("chunk"))


@query("chunk_prose", f"WITH RECURSIVE {_PAGES}, {chunk_sql.prose('pg')} SELECT source, page, chunk_no, md5(text) AS chunk FROM prose")
def chunk_prose(spark, d):
    """Greedy packing with overlaps."""
    return text.chunk_pages(pages(spark, d).withColumn("content_type", F.lit("prose"))).select("source", "page", "chunk_no", F.md5(F.col("text").cast("binary")).alias("chunk"))


@query("chunk_blocks", f"WITH RECURSIVE {fixtures.CATALOG_SQL}, tp AS (SELECT source, page, string_agg(text, chr(10) || chr(10) ORDER BY chunk_no) AS text FROM cat GROUP BY source, page), {chunk_sql.tables('tp')} SELECT source, page, chunk_no, text FROM tables")
def chunk_blocks(spark, d):
    """Table pages: logical blocks, or rows under their header."""
    p = fixtures.catalog(spark, d).groupBy("source", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return text.chunk_pages(p.withColumn("content_type", F.lit("table")))


_MAKER = "CASE WHEN contains(upper(source), 'SKF') OR contains(upper(t), 'SKF') THEN 'SKF' WHEN contains(upper(source), 'REXNORD') OR contains(upper(t), 'REXNORD') THEN 'Rexnord' WHEN contains(upper(source), 'LDK') OR contains(upper(t), 'LDK') THEN 'LDK' ELSE 'Unknown' END"
_INGEST = f"""WITH RECURSIVE {_PAGES}, ls AS (SELECT source, page, {_LN} AS ls FROM pg), sizes AS (SELECT source, count(*) AS pages FROM pg GROUP BY source),
  gone AS (SELECT source, list(line) AS gone FROM (SELECT source, line FROM (SELECT source, unnest(list_distinct(list_concat(ls[1:2], ls[-2:]))) AS line FROM ls) JOIN sizes USING (source)
    WHERE length(line) < 200 AND pages >= 4 GROUP BY source, line, pages HAVING count(*) >= 0.5e0 * pages) GROUP BY source),
  kept AS (SELECT source, page, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, trim(x, {_WS}))), chr(10)) END AS text FROM pg LEFT JOIN gone USING (source)),
  cleaned AS (SELECT source, page, {_CLEAN} AS text FROM kept), p AS (SELECT source, page, text, {_KIND} AS kind, nullif({_HEADER}, '') AS h FROM cleaned WHERE length(text) >= 50),
  told AS (SELECT source, page, kind, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY source ORDER BY page), '') AS section_header FROM p), f AS (SELECT source, min_by(text, page) AS t FROM p GROUP BY source),
  pp AS (SELECT source, page, text FROM p WHERE kind = 'prose'), tp AS (SELECT source, page, text FROM p WHERE kind = 'table'), {chunk_sql.prose("pp")}, {chunk_sql.tables("tp")},
  chunks AS (SELECT source || '__p' || page || '__c' || chunk_no AS chunk_id, source, page, section_header, kind AS content_type, {_MAKER} AS manufacturer, {chunk_sql.words("text")} AS word_count
    FROM (SELECT * FROM prose UNION ALL SELECT * FROM tables) JOIN told USING (source, page) JOIN f USING (source))"""


@query("ingest_chunks", f"{_INGEST} SELECT chunk_id, section_header, content_type, manufacturer, word_count FROM chunks")
def ingest_chunks(spark, d):
    """Pages to described chunks."""
    return text.ingest(pages(spark, d).select("source", "page", "text")).select("chunk_id", "section_header", "content_type", "manufacturer", "word_count")


@query("chunk_stats", f"{_INGEST} SELECT source, count(*) AS n_chunks, count(DISTINCT page) AS n_pages, round_even(avg(word_count), 0) AS mean_words FROM chunks GROUP BY source")
def chunk_stats(spark, d):
    return text.chunk_stats(text.ingest(pages(spark, d).select("source", "page", "text")))


_COS = "round(list_dot_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)) * list_dot_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))), 9)"


@query("knn_cosine", f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, round(score, 6) AS score FROM k WHERE k <= 5")
def knn_cosine(spark, d):
    """The five nearest of every hundredth vector among all."""
    v = table(spark, d, "embeddings")
    return retrieval.knn(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select("vec_id", "embedding"), 5)


_DESIGNATION = "nullif(regexp_extract(query, '(?i)\\b(6[12]\\d{2}(?:-2RS)?|ZA-?2115|UER\\d{3})\\b', 1), '')"
_CAND = "cand AS (SELECT query_id, chunk_id, round(((query_id * 31 + length(text) * 7) % 100) / 125e0, 6) AS score FROM qs, cat WHERE (query_id + page + chunk_no) % 3 = 0)"


def _hybrid_sql(k: int) -> str:
    """CTEs up to best (query_id, chunk_id, score): the best k chunks of qs among cand and the chunks that name the designation."""
    core = "regexp_replace(d, '^[A-Z]{1,3}-?', '')"
    return (
        f"h_q AS (SELECT query_id, upper({_DESIGNATION}) AS d FROM qs), "
        f"h_t AS (SELECT *, list_filter([d, regexp_replace(d, '-2RS$', ''), CASE WHEN length({core}) >= 3 THEN {core} END, CASE WHEN starts_with(d, 'UER') THEN 'VER' || d[4:] END, CASE WHEN starts_with(d, 'UER') THEN 'UFR' || d[4:] END, CASE WHEN starts_with(d, 'UER') THEN 'UBR' || d[4:] END], lambda x: x IS NOT NULL) AS terms FROM h_q), "
        "h_scan AS (SELECT query_id, chunk_id, 0.85e0 AS score FROM h_t, cat WHERE d IS NOT NULL AND len(list_filter(terms, lambda x: contains(upper(text), x))) > 0), h_both AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM cand UNION ALL SELECT * FROM h_scan) GROUP BY ALL), "
        "h_s AS (SELECT h_both.query_id, h_both.chunk_id, CASE WHEN d IS NULL THEN score ELSE CASE WHEN contains(upper(text), d) OR contains(upper(text), regexp_replace(d, '-2RS$', '')) THEN least(score * 1.3e0, 1e0) ELSE score END + CASE WHEN regexp_matches(text, '\\d{1,3},\\d{3}') OR regexp_matches(text, '\\d+\\.?\\d*\\s*(?:kN|KN|kn)') THEN 0.1e0 WHEN regexp_matches(text, '\\b\\d{4,6}\\b') THEN 0.05e0 ELSE 0 END END AS score FROM h_both JOIN cat USING (chunk_id) JOIN h_t ON h_t.query_id = h_both.query_id), "
        f"best AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM h_s) WHERE k <= {k})"
    )


@query("hybrid_score", f"WITH {fixtures.CATALOG_SQL}, {fixtures.QUERIES_SQL}, {_CAND}, {_hybrid_sql(5)} SELECT query_id, chunk_id, round(score, 6) AS score FROM best")
def hybrid_score(spark, d):
    q, c = fixtures.queries(spark), fixtures.catalog(spark, d)
    cand = c.crossJoin(F.broadcast(q)).where((F.col("query_id") + F.col("page") + F.col("chunk_no")) % 3 == 0)
    cand = cand.select("query_id", "chunk_id", F.round(((F.col("query_id") * 31 + F.length("text") * 7) % 100) / 125.0, 6).alias("score"))
    return retrieval.hybrid(q, cand, c).select("query_id", "chunk_id", "score")


@query("designation_regex", f"WITH {fixtures.QUERIES_SQL} SELECT query_id, {_DESIGNATION} AS designation FROM qs")
def designation_regex(spark, d):
    return fixtures.queries(spark).select("query_id", fn.designation(F.col("query")).alias("designation"))


_DES_SQL = "ds AS (SELECT * FROM (VALUES " + ", ".join(f"({fixtures.quoted(x)})" for x in fixtures.DESIGNATIONS) + ") AS v(designation))"
_NUM = "regexp_extract(regexp_replace(upper(trim(designation)), '[-/](2RS|ZZ|RS|Z|C3|C4)$', ''), '(\\d{3,})$', 1)"
_BORE = f"CASE WHEN replace(upper(designation), '-', '') = 'ZA2115' THEN 49.2e0 WHEN {_NUM} = '' THEN NULL ELSE CASE right({_NUM}, 2)::INT WHEN 0 THEN 10e0 WHEN 1 THEN 12e0 WHEN 2 THEN 15e0 WHEN 3 THEN 17e0 ELSE right({_NUM}, 2)::INT * 5e0 END END"


def _designations(spark):
    return spark.createDataFrame([(x,) for x in fixtures.DESIGNATIONS], "designation string")


@query("bore_code", f"WITH {_DES_SQL} SELECT designation, {_BORE} AS bore_mm FROM ds")
def bore_code(spark, d):
    return _designations(spark).select("designation", fn.bore_mm(F.col("designation")).alias("bore_mm"))


_KINDS = "CASE p_size % 3 WHEN 0 THEN 'ball' WHEN 1 THEN 'roller' ELSE 'other' END"


@query(
    "plausible",
    f"SELECT p_partkey, (b BETWEEN 2 AND 1000 AND CASE k WHEN 'ball' THEN c BETWEEN 0.5 AND 300 AND c / b BETWEEN 0.05 AND 5 WHEN 'roller' THEN c BETWEEN 1 AND 2000 AND c / b BETWEEN 0.1 AND 50 ELSE c BETWEEN 0.5 AND 2000 END) AS ok FROM (SELECT p_partkey, p_size * 1.5e0 - 1 AS b, p_retailprice / 5 - 100 AS c, {_KINDS} AS k FROM part)",
)
def plausible(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1.5 - 1).alias("b"), (F.col("p_retailprice") / 5 - 100).alias("c"), F.when(F.col("p_size") % 3 == 0, "ball").when(F.col("p_size") % 3 == 1, "roller").otherwise("other").alias("k"))
    return p.select("p_partkey", fn.plausible(F.col("b"), F.col("c"), F.col("k")).alias("ok"))


def _prose_sql(key):
    v = [f"TRY_CAST(nullif(regexp_extract(text, {fixtures.quoted('(?i)' + p)}, 1), '') AS DOUBLE)" for p in ratings.PROSE[key]]
    return "coalesce(" + ", ".join(f"CASE WHEN {x} > 0.5 AND {x} < 2000 THEN {x} END" for x in v) + ")"


@query("prose_ratings", f"WITH {fixtures.CATALOG_SQL} SELECT chunk_id, {_prose_sql('c_kn')} AS c_kn, {_prose_sql('c0_kn')} AS c0_kn FROM cat")
def prose_ratings(spark, d):
    return fixtures.catalog(spark, d).select("chunk_id", *[c.alias(k) for k, c in extraction.prose_ratings().items()])


@query("adjacent_merge", f"WITH {fixtures.CATALOG_SQL} SELECT chunk_id, string_agg(text, chr(10)) OVER (PARTITION BY source, page ORDER BY chunk_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS merged FROM cat")
def adjacent_merge(spark, d):
    return extraction.merged_neighbours(fixtures.catalog(spark, d)).select("chunk_id", "merged")


#: The wanted bearings with the part of their names that every spelling holds, and whose files count.
_WANTED = "wanted AS (SELECT * FROM (VALUES ('6205', 'SKF', 'ball', 14.8e0, 25e0, '6205', 25e0, ['skf']), ('6204', 'SKF', 'ball', 13.5e0, 20e0, '6204', 20e0, ['skf']), ('ZA-2115', 'Rexnord', 'roller', 90.3e0, 49.2e0, '2115', 49.2e0, ['rexnord', 'catalogo']), ('UER204', 'LDK', 'ball', 12e0, 20e0, '204', 20e0, ['ldk', 'mounted'])) AS v(designation, manufacturer, bearing_type, known_c_kn, known_bore_mm, core, bore, files))"
_MERGED = "merged AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY source, page ORDER BY chunk_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM cat)"
_ALL_HITS = "hits AS (SELECT w.*, c.chunk_id, c.source, c.page, c.m FROM merged c JOIN wanted w ON contains(upper(c.text), w.core))"


_METRIC, _GROUPED, _IMPERIAL, _SPACE = r"[0-9]+(?:[.,][0-9]*)?", r"(?:[0-9]{1,3}(?:\s[0-9]{3})+\b|[0-9]+)(?:[.,][0-9]*)?", r"(?:[0-9]{1,3}(?:,[0-9]{3})+\b|[0-9]+)(?:[.][0-9]*)?", r"\s"


def _cells(line: str, pattern: str, gone: str) -> str:
    return f"list_transform(regexp_extract_all({line}, '{pattern}'), lambda x: replace(regexp_replace(x, '{gone}', '', 'g'), ',', '.')::DOUBLE)"


def _rated_sql(src: str) -> str:
    """CTEs up to rated (the columns of src with c_kn, c0_kn, found_bore_mm): hits by line, each line's layout as a case, the first line that tells a rating, else sentences."""
    pair = "list_filter(list_transform(range(1, len(usable)), lambda k: [usable[k], usable[k + 1]]), lambda p: p[1] > p[2] AND p[1] BETWEEN 0.5 AND 300 AND p[1] / bore BETWEEN 0.05 AND 5)[1]"
    lbf = "0.00444822e0"
    return f"""r_own AS (SELECT *, len(list_filter(files, lambda f: contains(lower(source), f))) > 0 AS own FROM {src}), r_hits AS (SELECT *, string_split(m, chr(10)) AS ls FROM r_own WHERE own OR designation NOT IN (SELECT designation FROM r_own WHERE own)),
      r_at AS (SELECT * FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM r_hits) WHERE contains(upper(ls[i]), core)),
      r_line AS (SELECT *, {_cells('ls[i]', _METRIC, ' ')} AS line_row, coalesce(list_max(list_filter(range(greatest(1, i - 12), i - 1), lambda e: regexp_matches(ls[e], '^\\s*\\*?\\s*[0-9]{{4}}'))), greatest(0, i - 13)) AS entry FROM r_at),
      r_col AS (SELECT *, CASE WHEN len(line_row) < 4 THEN flatten(list_transform(range(entry + 1, i), lambda e: CASE WHEN starts_with(lower(trim(ls[e])), 'principal') THEN []::DOUBLE[] ELSE {_cells('ls[e]', _GROUPED, _SPACE)} END)) END AS col FROM r_line),
      r_row AS (SELECT *, coalesce(col, line_row) AS row, list_position(list_transform(col, lambda x: x >= 5000), true) >= 5 AND col[3] > col[4] AND col[4] > 0 AS is_col, list_filter(coalesce(col, line_row), lambda x: x > 1 AND x < 500) AS usable,
        list_filter(flatten(list_transform(ls[i + 1 : i + 24], lambda l: {_cells('l', _IMPERIAL, ',')})), lambda x: x > 10000 AND x < 200000) AS loads FROM r_col),
      r_told AS (SELECT *, CASE WHEN is_col THEN col[3] WHEN manufacturer = 'Rexnord' THEN round(coalesce(loads[1], CASE WHEN list_max(row) > 10000 THEN list_max(row) END) * {lbf}, 2) ELSE {pair}[1] END AS c,
        CASE WHEN is_col THEN col[4] WHEN manufacturer = 'Rexnord' THEN round(loads[2] * {lbf}, 2) ELSE {pair}[2] END AS c0, CASE WHEN is_col OR (manufacturer <> 'Rexnord' AND list_contains(row, bore)) THEN bore END AS b FROM r_row),
      r_best AS (SELECT designation, chunk_id, min_by({{'c': c, 'c0': c0, 'b': b}}, i) AS x FROM r_told WHERE c IS NOT NULL GROUP BY designation, chunk_id),
      rated AS (SELECT * FROM (SELECT h.* EXCLUDE (text), CASE WHEN x IS NULL THEN {_prose_sql('c_kn')} ELSE x.c END AS c_kn, CASE WHEN x IS NULL THEN {_prose_sql('c0_kn')} ELSE x.c0 END AS c0_kn, x.b AS found_bore_mm FROM (SELECT *, m AS text FROM r_hits) h LEFT JOIN r_best USING (designation, chunk_id)) WHERE c_kn IS NOT NULL)"""


_FOUND = """found AS (SELECT designation, min_by({'c': c_kn, 'c0': c0_kn, 'b': b, 's': source, 'p': page}, chunk_id) AS x FROM (SELECT *, coalesce(found_bore_mm, bore) AS b FROM rated)
        WHERE b BETWEEN 2 AND 1000 AND CASE bearing_type WHEN 'ball' THEN c_kn BETWEEN 0.5 AND 300 AND c_kn / b BETWEEN 0.05 AND 5 ELSE c_kn BETWEEN 1 AND 2000 AND c_kn / b BETWEEN 0.1 AND 50 END GROUP BY designation),
      tiers AS (SELECT w.*, x, CASE WHEN x IS NULL THEN 'fallback' WHEN e < 0.02e0 THEN 'high' WHEN e < 0.10e0 THEN 'medium' WHEN e < 0.35e0 THEN 'low' ELSE 'fallback' END AS tier FROM (SELECT w.*, x, abs(x.c - known_c_kn) / known_c_kn AS e FROM wanted w LEFT JOIN found USING (designation)) w),
      params AS (SELECT designation, manufacturer, known_c_kn, CASE tier WHEN 'fallback' THEN known_bore_mm ELSE x.b END AS bore_mm, CASE tier WHEN 'fallback' THEN known_c_kn ELSE x.c END AS c_kn, CASE WHEN tier <> 'fallback' THEN x.c0 END AS c0_kn, CASE bearing_type WHEN 'ball' THEN 3e0 ELSE 10e0 / 3 END AS life_exponent, bearing_type,
        NULL::BIGINT AS n_balls_or_rollers, NULL::DOUBLE AS pitch_diameter_mm, NULL::DOUBLE AS ball_or_roller_diameter_mm, NULL::DOUBLE AS contact_angle_deg, CASE tier WHEN 'fallback' THEN 'ground_truth' ELSE x.s END AS source_file, CASE WHEN tier <> 'fallback' THEN x.p END AS source_page, tier AS extraction_confidence FROM tiers)"""
_PARAMS = "SELECT designation, manufacturer, round(bore_mm, 6) AS bore_mm, round(c_kn, 6) AS c_kn, round(c0_kn, 6) AS c0_kn, round(life_exponent, 6) AS life_exponent, bearing_type, n_balls_or_rollers, pitch_diameter_mm, ball_or_roller_diameter_mm, contact_angle_deg, source_file, source_page, extraction_confidence FROM params"
_EXTRACTED = f"WITH {fixtures.CATALOG_SQL}, {_WANTED}, {_MERGED}, {_ALL_HITS}, {_rated_sql('hits')}, {_FOUND}"


def _hits(spark, d=None):
    """Chunks that hold a spelling of each wanted bearing."""
    c = extraction.merged_neighbours(fixtures.catalog(spark, d))
    wanted = extraction.bearings(spark)
    terms = wanted.withColumn("_terms", retrieval.search_terms(F.col("designation")))
    return c.join(F.broadcast(terms), F.exists("_terms", lambda x: F.contains(F.upper("text"), x))).drop("_terms")


@query("table_ratings", f"WITH {fixtures.CATALOG_SQL}, {_WANTED}, {_MERGED}, {_ALL_HITS}, {_rated_sql('hits')} SELECT designation, chunk_id, round(c_kn, 6) AS c_kn, round(c0_kn, 6) AS c0_kn, round(found_bore_mm, 6) AS found_bore_mm FROM rated")
def table_ratings(spark, d):
    """Ratings found in each hit from its maker's files."""
    return extraction.rated(extraction.of_maker(_hits(spark, d))).select("designation", "chunk_id", "c_kn", "c0_kn", "found_bore_mm")


@query("extracted_params", f"{_EXTRACTED} {_PARAMS}")
def extracted_params(spark, d):
    return extraction.extract(extraction.bearings(spark), _hits(spark, d)).drop("raw_text")


_KNOWN = "CASE upper(d) " + " ".join(f"WHEN {fixtures.quoted(k)} THEN {fixtures.quoted(v)}" for k, v in retrieval.KNOWN.items()) + " ELSE '' END"
_EXPANDED = f"SELECT query_id, unnest(CASE WHEN d IS NULL THEN [query] ELSE [query, d || ' specifications dimensions load rating', trim({_KNOWN} || ' ' || d || ' bearing')] END) AS query FROM (SELECT query_id, query, {_DESIGNATION} AS d FROM qs)"


def _vectors_sql(name: str, src: str, key: str, text: str) -> str:
    """CTEs name (key, place, n: the text's words hashed to that place) and name_size (key, size: its length)."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"{name} AS (SELECT {key}, ('0x' || md5(w)[1:8])::BIGINT % 256 AS place, count(*) AS n FROM (SELECT {key}, unnest({words}) AS w FROM {src}) GROUP BY ALL), {name}_size AS (SELECT {key}, sqrt(sum(n * n)) AS size FROM {name} GROUP BY {key})"


def _retrieved_sql(k: int) -> str:
    """CTEs up to best for qs (query_id, query) over cat: 3k candidates of each query and its expansions by the angle of hashed words, then the hybrid ranking."""
    return (
        f"ex AS ({_EXPANDED}), {_vectors_sql('qv', 'ex', 'query_id, query', 'query')}, {_vectors_sql('cv', 'cat', 'chunk_id', 'text')}, "
        "dots AS (SELECT query_id, query, chunk_id, sum(qv.n * cv.n) AS dot FROM qv JOIN cv USING (place) GROUP BY ALL), "
        "angles AS (SELECT ex.query_id, ex.query, cat.chunk_id, coalesce(round(dot / (a.size * b.size), 9), 0e0) AS score FROM ex CROSS JOIN cat LEFT JOIN dots ON dots.query_id = ex.query_id AND dots.query = ex.query AND dots.chunk_id = cat.chunk_id "
        "LEFT JOIN qv_size a ON a.query_id = ex.query_id AND a.query = ex.query LEFT JOIN cv_size b ON b.chunk_id = cat.chunk_id), "
        f"cand AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, chunk_id) AS k FROM angles) WHERE k <= {3 * k}), {_hybrid_sql(k)}"
    )


@query("retrieve_hybrid", f"WITH {fixtures.CATALOG_SQL}, {fixtures.QUERIES_SQL}, {_retrieved_sql(5)} SELECT query_id, chunk_id, round(score, 6) AS score FROM best")
def retrieve_hybrid(spark, d):
    """Vector and keyword retrieval end to end, with hashed words as vectors."""
    return retrieval.retrieve(fixtures.queries(spark), fixtures.catalog(spark, d)).select("query_id", "chunk_id", "score")


_ASKED = "qs AS (SELECT designation || '#' || k AS query_id, [designation || ' specifications', trim(manufacturer || ' ' || designation || ' load rating'), designation || ' dimensions', designation || ' dynamic load'][k] AS query FROM wanted, (SELECT unnest(range(1, 5)) AS k))"
_RETRIEVED_HITS = "hits AS (SELECT w.*, c.chunk_id, c.source, c.page, c.m FROM (SELECT DISTINCT split_part(query_id, '#', 1) AS designation, chunk_id FROM best) JOIN merged c USING (chunk_id) JOIN wanted w USING (designation))"


@query("full_extraction", f"WITH {fixtures.CATALOG_SQL}, {_WANTED}, {_ASKED}, {_retrieved_sql(15)}, {_MERGED}, {_RETRIEVED_HITS}, {_rated_sql('hits')}, {_FOUND} {_PARAMS}")
def full_extraction(spark, d):
    """Queries, retrieval, neighbours, ratings and choice in one job."""
    return extraction.run(fixtures.catalog(spark, d)).drop("raw_text")


@query("confidence_counts", f"{_EXTRACTED} SELECT extraction_confidence, count(*) AS n, round(avg(c_kn), 6) AS mean_c_kn FROM params GROUP BY extraction_confidence")
def confidence_counts(spark, d):
    p = extraction.extract(extraction.bearings(spark), _hits(spark, d))
    return p.groupBy("extraction_confidence").agg(F.count("*").alias("n"), F.avg("c_kn").alias("mean_c_kn"))


@query("extraction_report", f"{_EXTRACTED} SELECT designation, printf('%s (%s): bore %.1f mm, C %.2f kN, confidence %s', designation, manufacturer, bore_mm, c_kn, extraction_confidence) || CASE WHEN c_kn > 0 THEN printf(' (error: %.1f%%)', abs(c_kn - known_c_kn) / known_c_kn * 100) ELSE '' END AS line FROM params")
def extraction_report(spark, d):
    w = extraction.bearings(spark)
    return extraction.report(extraction.extract(w, _hits(spark, d)), w)


_C = "CASE WHEN p_size % 7 = 0 THEN NULL ELSE 14.8e0 * (1 + (p_size - 25) / 50e0) END"
_K = "CASE WHEN p_size % 5 = 0 THEN NULL ELSE 14.8e0 END"


@query("extract_tier", f"SELECT p_partkey, CASE WHEN c IS NULL THEN 'fallback' WHEN k IS NULL THEN 'medium' WHEN abs(c - k) / k < 0.02e0 THEN 'high' WHEN abs(c - k) / k < 0.10e0 THEN 'medium' WHEN abs(c - k) / k < 0.35e0 THEN 'low' ELSE 'fallback' END AS tier FROM (SELECT p_partkey, {_C} AS c, {_K} AS k FROM part)")
def extract_tier(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.lit(14.8) * (1 + (F.col("p_size") - 25) / 50.0)).alias("c"), F.when(F.col("p_size") % 5 != 0, F.lit(14.8)).alias("k"))
    return p.select("p_partkey", extraction.tier("c", "k").alias("tier"))


@query("expanded_queries", f"WITH {fixtures.QUERIES_SQL} {_EXPANDED}")
def expanded_queries(spark, d):
    return retrieval.expanded_queries(fixtures.queries(spark))
