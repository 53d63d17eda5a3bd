"""An invented catalog that shows the layouts of bearing tables: some pages by hand, and an entry for each row of `part`, four to a page; and queries to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: source, page, chunk_no, text
CATALOG = [
    ("skf.pdf", 1, 0, "SKF rolling bearings\nGeneral catalogue"),
    ("skf.pdf", 2, 0, "Principal dimensions\n52\n15\n14,8\n7,8\n0,335\n28 000\n18 000\n0,13\n* 6205"),
    ("skf.pdf", 2, 1, "47\n14\n13,5\n6,55\n0,28\n32 000\n20 000\n0,11\n* 6204"),
    ("skf.pdf", 3, 0, "6205 25 52 15 14.8 7.8 0.335 28000 18000"),
    ("skf.pdf", 3, 1, "6204 20 47 14 13.5 6.55 0.28 32000 20000"),
    ("skf.pdf", 4, 0, "The basic dynamic load rating of the 6205 is 14.8 kN, its static load rating is 7.8 kN at 25 mm."),
    ("skf.pdf", 5, 0, "Bearings of the 6205-2RS type have seals. C = 14.0 kN. C0 = 7.8 kN."),
    ("skf.pdf", 6, 0, "Mounting instructions\nKeep bearings clean before mounting."),
    ("rexnord_catalogo.pdf", 1, 0, "Rexnord roller bearings\nload ratings in pounds"),
    ("rexnord_catalogo.pdf", 2, 0, "ZA-2115\n3115\n5115\nrpm 5000\n6\n2200\n20,300\n26,200"),
    ("rexnord_catalogo.pdf", 3, 0, "Series 2115 shafts\n49.2 mm"),
    ("mounted-bearing.pdf", 1, 0, "LDK bearing units\nInsert bearings"),
    ("mounted-bearing.pdf", 2, 0, "UCF204 20 12.0 6.65 86 64"),
    ("mounted-bearing.pdf", 2, 1, "VER204 20 12.0 6.65"),
    ("mounted-bearing.pdf", 3, 0, "UER204 units: dynamic load rating: 12.0 and static load rating: 6.65"),
    ("mounted-bearing.pdf", 4, 0, "Greasing 10000 hours"),
    ("other.pdf", 1, 0, "Motors and pumps 2000 rpm"),
    ("other.pdf", 2, 0, "A 6308 needs 40 mm of shaft"),
]
QUERIES = [(1, "6205-2RS specifications"), (2, "load rating of ZA-2115"), (3, "UER204 dimensions"), (4, "how to mount bearings"), (5, "6204 bearing"), (6, "za2115"), (7, "6308 shaft")]
DESIGNATIONS = ["6205", "6204", "6205-2RS", "UER204", "ZA-2115", "za2115", "6200", "6201", "6202", "6203", "61", "NU1008", "6004/ZZ"]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: By maker: its file, its designations (<k>: two digits of the row), and layouts of an entry with places for designation, ratings (with point or comma) and thousands of pounds.
_MAKERS = [
    ("skf_parts.pdf", ["6205", "6204", "62<k>", "6205-2RS", "63<k>"], [
        "52\n15\n<c,>\n<s,>\n0,335\n28 000\n18 000\n0,13\n* <d>",
        "<d> 25 52 15 <c.> <s.> 0.335 28000 18000",
        "The basic dynamic load rating of the <d> is <c.> kN, its static load rating is <s.> kN.",
    ]),
    ("rexnord_catalogo_parts.pdf", ["ZA-2115", "ZA-2<k>5", "2115"], ["<d>\n3115\nrpm 5000\n<k>,<p>\n<k>,9<k>", "Shafts of the <d> series: <k> mm"]),
    ("ldk_mounted_parts.pdf", ["UCF204", "VER204", "UER2<k>", "UER204"], ["<d> 20 <c.> <s.> 86 64", "<d> units: dynamic load rating: <c.> and static load rating: <s.>"]),
]


def _pick(texts: list[str], of: str) -> str:
    return f"CASE CAST({of} % {len(texts)} AS INT) " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END"


def _tenths(x: str, mark: str) -> str:
    return f"CAST(CAST(floor(({x}) / 10) AS BIGINT) AS STRING) || '{mark}' || CAST(({x}) % 10 AS STRING)"


_PAGE, _C, _S = "CAST(floor(p_partkey / 4) AS BIGINT)", "p_size * 4 + p_partkey % 9 + 30", "p_size * 2 + p_partkey % 5 + 20"
_FILLED = {"<d>": "d", "<k>": "CAST(p_partkey % 60 + 10 AS STRING)", "<p>": "CAST(p_partkey % 800 + 100 AS STRING)", "<c.>": _tenths(_C, "."), "<s.>": _tenths(_S, "."), "<c,>": _tenths(_C, ","), "<s,>": _tenths(_S, ",")}


def _maker(of: int, page: str, row: str) -> str:
    return _pick([_pick([quoted(t).replace("\n", "' || chr(10) || '") for t in m[of]], row) for m in _MAKERS], page)


def _filled(text: str) -> str:
    for place, x in _FILLED.items():
        text = f"replace({text}, '{place}', {x})"
    return text


#: Columns of the entries made of `part`, which Spark and the SQL twins read alike.
_NAMED = ["p_partkey", "p_size", f"{_PAGE} AS page", "CAST(p_partkey % 4 AS BIGINT) AS chunk_no", f"{_pick([f"'{m[0]}'" for m in _MAKERS], _PAGE)} AS source", f"{_maker(1, _PAGE, 'p_partkey')} AS d", f"{_maker(2, _PAGE, 'floor(p_partkey / 3)')} AS layout"]
_TOLD = ["source || '__p' || CAST(page AS STRING) || '__c' || CAST(chunk_no AS STRING) AS chunk_id", "source", "page", "chunk_no", f"{_filled('layout')} AS text"]


def catalog(spark: SparkSession, d: str | None = None) -> DataFrame:
    """chunk_id, source, page, chunk_no, text; with the tables' folder also an entry for each row of `part`."""
    own = spark.createDataFrame([(f"{s}__p{p}__c{c}", s, p, c, t) for s, p, c, t in CATALOG], "chunk_id string, source string, page long, chunk_no long, text string")
    return own if d is None else own.unionByName(spark.read.parquet(f"{d}/part.parquet").selectExpr(*_NAMED).selectExpr(*_TOLD))


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id long, query string")


CATALOG_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(f'{s}__p{p}__c{c}')}, {quoted(s)}, {p}::BIGINT, {c}::BIGINT, {quoted(t)})" for s, p, c, t in CATALOG) + f") AS v(chunk_id, source, page, chunk_no, text) UNION ALL SELECT {', '.join(_TOLD)} FROM (SELECT {', '.join(_NAMED)} FROM part))"
QUERIES_SQL = "qs AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {quoted(q)})" for i, q in QUERIES) + ") AS v(query_id, query))"
