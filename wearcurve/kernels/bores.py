"""Bores and plausibility of single values (the column versions are in wearcurve.functions)."""

from __future__ import annotations

import re

from wearcurve.functions import ENDINGS, SMALL_BORES, SPECIAL_BORES


def bore_of(designation: str) -> float | None:
    d = designation.strip().upper()
    if (special := SPECIAL_BORES.get(d.replace("-", ""))) is not None:
        return special
    bare = next((d[: -len(e) - 1] for e in ENDINGS if d.endswith(("-" + e, "/" + e))), d)
    m = re.search(r"\d{3,}$", bare)
    code = int(m[0][-2:]) if m else None
    return None if code is None else SMALL_BORES.get(code, code * 5.0)


def is_plausible(bore: float, c: float, kind: str) -> bool:
    if not 2 <= bore <= 1000:
        return False
    if kind == "ball":
        return 0.5 <= c <= 300 and 0.05 <= c / bore <= 5
    if kind == "roller":
        return 1 <= c <= 2000 and 0.1 <= c / bore <= 50
    return 0.5 <= c <= 2000
