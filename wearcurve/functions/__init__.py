"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: Column, high: Column) -> Column:
    """NaN becomes high (NaN is Spark's largest double)."""
    return F.greatest(low, F.least(high, x))


def percent_change(before: Column, after: Column) -> Column:
    return (before - after) / before * 100


def lookup(key: Column, table: dict[str, str], default: str | Column) -> Column:
    """A small fixed dictionary as an expression."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default) if isinstance(default, str) else default)


#: Bores of codes below 4, in mm, and of special designations.
SMALL_BORES = {0: 10.0, 1: 12.0, 2: 15.0, 3: 17.0}
SPECIAL_BORES = {"ZA2115": 49.2}
#: Endings that name seals, shields and clearances.
ENDINGS = ("2RS", "ZZ", "RS", "Z", "C3", "C4")


def bore_mm(designation: Column) -> Column:
    """The bore that a designation's last two digits code; null where there are fewer than 3 closing digits."""
    d = F.upper(F.trim(designation))
    special = F.lit(None).cast("double")
    for name, bore in SPECIAL_BORES.items():
        special = F.when(F.replace(d, F.lit("-"), F.lit("")) == name, bore).otherwise(special)
    digits = F.regexp_extract(F.regexp_replace(d, rf"[-/]({'|'.join(ENDINGS)})$", ""), r"(\d{3,})$", 1)
    code = F.when(F.length(digits) >= 3, F.right(digits, F.lit(2)).cast("int"))
    small = F.lit(None).cast("double")
    for c, bore in SMALL_BORES.items():
        small = F.when(code == c, bore).otherwise(small)
    return F.coalesce(special, small, F.when(code >= 4, code * F.lit(5.0)))


def plausible(bore: Column, c: Column, kind: Column) -> Column:
    """Ranges of load ratings (kN) and of their ratio to the bore, for ball and roller bearings."""
    ratio = c / bore
    ball = c.between(0.5, 300.0) & ratio.between(0.05, 5.0)
    roller = c.between(1.0, 2000.0) & ratio.between(0.1, 50.0)
    return bore.between(2.0, 1000.0) & F.when(kind == "ball", ball).when(kind == "roller", roller).otherwise(c.between(0.5, 2000.0))


#: Fixed value: bearing designations that queries may name.
DESIGNATION = r"(?i)\b(6[12]\d{2}(?:-2RS)?|ZA-?2115|UER\d{3})\b"


def designation(text: Column) -> Column:
    """The first designation in a text as it's written; null if none."""
    return F.nullif(F.regexp_extract(text, DESIGNATION, 1), F.lit(""))
