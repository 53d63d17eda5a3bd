"""Secret scan by multipart credential linking (native expressions only).

Strong parts are reported as they are. Weak parts (names of accounts, short assignments, opaque
strings, endpoints) are reported only where complementary parts lie in the same scope: an
interval join of the parts of one text, |start - start| <= SCOPE code points. A text is held against a pattern only if it has the characters
that every match needs (GATES). Each part is compared with those
beside it in the order of starts, as many as its scope can hold (parts of one kind
don't overlap and have MIN_PART characters at least), so the join is exact and linear in the number of parts.

Defined results: a null text counts as empty and has no spans; null doc_ids and repeated rows are
kept; other columns are not read. Positions are code points, end exclusive. Work grows with the length of a text and the number of its
matches; running sums are taken in runs of RUN, so no array is copied for each match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 256
MIN_PART = 8
#: kind, pattern, group whose length counts, its least length, role, strong. In this order ties are listed.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret", True),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "identifier", True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, "secret", True),
    ("ident", r"""(?i:(?:client|account|tenant|user|login|access_?key)(?:_?(?:id|name))?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3, "identifier", False),
    ("weak_assign", r"""(?i:pwd|passphrase|credentials?|private_?key|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 4, "secret", False),
    ("blob", r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24, "secret", False),
    ("endpoint", r"""(?i:https?|ftp|s3|gs|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, 8, "endpoint", False),
]
NEAR = len(KINDS) * (SCOPE // MIN_PART + 1)
PART = "array<struct<s:bigint,rank:int,e:bigint,kind:string,role:string,strong:boolean>>"


#: What a text with a match of the kind must hold.
GATES: dict[str, Callable[[Column], Column]] = {
    **dict.fromkeys(("assign", "ident", "weak_assign"), lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))),
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "blob": lambda t: t.rlike("[0-9]"),
    "endpoint": lambda t: F.contains(t, F.lit("://")),
}
RUN = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(n: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int"))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running result of add (from 0) over an array of longs: the results of runs first, then those within each run."""
    inside = lambda v, b: F.sequence(b * RUN, F.least(F.size(v), b * RUN + RUN) - 1)
    more = lambda a, x: F.concat(a, F.array(add(F.get(a, F.size(a) - 1), x)))

    def over(v: Column) -> Column:
        runs = F.transform(_blocks(F.size(v)), lambda b: F.aggregate(inside(v, b), F.lit(0).cast("long"), lambda a, j: add(a, F.get(v, j))))
        before = F.aggregate(runs, F.array(F.lit(0).cast("long")), more)
        each = lambda o, b: F.slice(F.aggregate(inside(v, b), F.array(F.get(o, b)), lambda a, j: more(a, F.get(v, j))), 2, RUN)
        return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(_once(before, lambda o: F.flatten(F.transform(_blocks(F.size(v)), lambda b: each(o, b)))))

    return _once(values, over)


def _parts(text: str, k: int) -> Column:
    """Spans of one kind: the text between the matches and the matches alternate, so running sums of their lengths are the positions."""
    kind, pattern, group, least, role, strong = KINDS[k]
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    width = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = lengths(F.split(text, pattern, -1))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(w: Column) -> Column:
        ends = _running(F.zip_with(F.slice(gaps, 1, F.size(w)), w, lambda g, x: g + x), lambda a, x: a + x)
        return F.arrays_zip(ends.alias("e"), w.alias("w"), value.alias("v"))

    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") if kind == "blob" else F.lit(True)
    good = F.filter(_once(width, placed), lambda m: (F.length(m["v"]) >= least) & mixed(m["v"]))
    made = F.transform(good, lambda m: F.struct((m["e"] - m["w"]).alias("s"), F.lit(k).alias("rank"), m["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(strong).alias("strong")))
    gate = GATES[kind](F.col(text)) & F.col(text).rlike(pattern) if kind in GATES else F.col(text).rlike(pattern)
    return F.when(gate, made).otherwise(F.array().cast(PART))


def find_parts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + _text + parts: all strong parts, and those weak ones whose complements are in their scope, by start and kind. One row per row; no shuffle."""
    d = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.select("*", *[_parts("_text", k).alias(f"_p{k}") for k in range(len(KINDS))])
    d = d.withColumn("_all", F.array_sort(F.concat(*[F.col(f"_p{k}") for k in range(len(KINDS))])))
    near = f"sequence(greatest(i - {NEAR}, 0), least(i + {NEAR}, size(_all) - 1))"  # places in the order of starts
    other = lambda roles: f"exists({near}, j -> get(_all, j).role IN ({roles}) AND abs(get(_all, j).s - p.s) <= {SCOPE} AND (get(_all, j).e <= p.s OR p.e <= get(_all, j).s))"
    linked = f"""filter(_all, (p, i) -> p.strong
        OR (p.role = 'identifier' AND {other("'secret'")})
        OR (p.role = 'secret' AND {other("'identifier', 'endpoint'")})
        OR (p.role = 'endpoint' AND {other("'secret'")} AND {other("'identifier'")}))"""
    has_weak = F.exists("_all", lambda p: ~p["strong"])
    return d.select(*keep, "_text", F.when(has_weak, F.expr(linked)).otherwise(F.col("_all")).alias("parts"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every reported span of its text replaced by <kind>; overlapping spans become one, named by the first. Null texts stay null."""
    found = find_parts(df.select(F.struct("*").alias("_row"), F.col(text).alias("text")), "text", ("_row",))
    reach = _running(F.transform("parts", lambda p: p["e"]), F.greatest)  # how far the spans reach
    spans = F.transform(F.arrays_zip(F.col("parts").alias("p"), reach.alias("r")), lambda x: F.struct(x["p"]["s"].alias("s"), x["p"]["kind"].alias("kind"), x["r"].alias("r")))
    behind = lambda a, i: F.when(i > 0, F.get(a, i - 1)["r"]).otherwise(F.lit(0).cast("long"))
    # the first span of each run of overlapping ones, with the end of what is before it
    heads = _once(spans, lambda a: F.filter(F.transform(a, lambda x, i: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), behind(a, i).alias("b"))), lambda x: x["s"] >= x["b"]))
    part = lambda t, start, end: F.substr(t, (start + 1).cast("int"), (end - start).cast("int"))

    def block(h: Column, b: Column) -> Column:
        """The text of RUN heads, read from one cut of the whole text, since a cut walks the text from its start."""

        def pieces(some: Column) -> Column:
            low = F.get(some, F.lit(0))["b"]
            cut = part(F.col("_text"), low, F.get(some, F.size(some) - 1)["s"])
            return _once(cut, lambda c: F.array_join(F.transform(some, lambda x: F.concat(part(c, x["b"] - low, x["s"] - low), F.lit("<"), x["kind"], F.lit(">"))), ""))

        return _once(F.slice(h, b * RUN + 1, RUN), pieces)

    told = _once(heads, lambda h: F.array_join(F.transform(_blocks(F.size(h)), lambda b: block(h, b)), ""))
    cut = F.concat(told, F.substr("_text", (F.array_max(F.transform("parts", lambda p: p["e"])) + 1).cast("int")))
    new = F.when(F.col(f"_row.{text}").isNull(), F.lit(None)).when(F.size("parts") == 0, F.col("_text")).otherwise(cut)
    return found.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + counts of the base kinds, the hash of the base spans, and all spans."""
    told = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["s"].cast("string"), p["e"].cast("string"))), ",")
    base = F.filter("parts", lambda p: p["strong"])
    count = lambda kind: F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long")
    return found.select(*keep, *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(told(base), 256).alias("base_sha256"), told("parts").alias("spans"))
