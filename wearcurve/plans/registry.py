"""Registration of queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wearcurve.plans.views import NUDGE, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_ROUND, _NUDGED = ", 6)", f" + {NUDGE}, 6) + 0e0"


def _nudged(sql: str) -> str:
    """Every round(x, 6) of the SQL with the nudge and without negative zero, once. A 6 that ends another call is an error: it would be taken for a rounding."""
    plain = sql.replace(_NUDGED, _ROUND)
    for at in re.finditer(re.escape(_ROUND), plain):
        depth, k = 1, at.start()
        while depth:
            k -= 1
            depth += {")": 1, "(": -1}.get(plain[k], 0)
        if not plain[:k].endswith("round"):
            raise ValueError(f"not a rounding: {plain[max(0, k - 20) : at.end()]}")
    return plain.replace(_ROUND, _NUDGED)


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); doubles of its result are rounded to 6 decimals, as in its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = _nudged(sql)
        return f

    return add
