"""Load ratings in catalog text of one bearing: cells of numbers by a catalog's notation, and the layouts in which catalogs set them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, takewhile

from wearcurve.kernels.bores import bore_of, is_plausible

#: kN of a pound-force, spellings that scans confuse, housings that take the same insert bearing.
LBF_KN = 0.00444822
CONFUSED = {"UER": ["VER", "UFR", "UBR", "LIER", "UERZ"], "UCC": ["VCC", "UGC"], "UCP": ["VCP"]}
HOUSINGS = ["UCF", "UEF", "UCFB", "UCP", "UCPH", "UCT", "UCTB", "UCFA", "UCFL", "UCFC", "UCSB", "UCPE"]
#: Lines above and below a designation that belong to it, cells that make a row, places of C and C0 in a column of sizes, the first place of a speed
#: and the least one, and ranges of ratings in pounds, in kN within rows, and in sentences.
ABOVE, BELOW, ROW_CELLS = 12, 24, 4
C_PLACE, C0_PLACE, SPEED_PLACE, LEAST_SPEED = 2, 3, 4, 5000
POUNDS, CELL_KN, PROSE_KN = (10_000, 200_000), (1, 500), (0.5, 2000)
NEAR_KNOWN = 0.1


@dataclass(frozen=True)
class Notation:
    """How a catalog writes numbers: its decimal mark, and the mark between groups of three digits."""

    decimal: str
    group: str = ""

    def cells(self, line: str) -> list[float]:
        whole = rf"\d{{1,3}}(?:{self.group}\d{{3}})+\b|\d+" if self.group else r"\d+"
        found = re.findall(rf"(?:{whole})(?:{self.decimal}\d*)?", line)
        return [float(re.sub(r"[^\d.]", "", x.replace(",", ".") if self.group != "," else x)) for x in found]


METRIC, METRIC_GROUPED, IMPERIAL = Notation("[.,]"), Notation("[.,]", r"\s"), Notation("[.]", ",")


def names_of(designation: str) -> set[str]:
    """Spellings under which a catalog may list a bearing: without seal or prefix, as scans read it, and in its housings."""
    full = designation.upper()
    prefix, digits = re.fullmatch(r"([A-Z]{0,3}-?)(.*)", full).groups()
    names = {full, full.removesuffix("-2RS"), digits}
    names.update(other + full[len(own) :] for own, others in CONFUSED.items() if full.startswith(own) for other in others)
    if len(prefix) > 1 and prefix.startswith("U") and digits[:3].isdigit() and len(digits) >= 3:
        names.update(h + digits[:3] for h in HOUSINGS)
    return names - {""}


def _is_entry(line: str) -> bool:
    """Whether a line begins with another bearing's number."""
    first = line.strip().removeprefix("*").lstrip()[:4]
    return len(first) == 4 and first.isdecimal()


def column_above(lines: list[str], at: int) -> list[float]:
    """Cells of the lines between the entry before and the designation at that line (the line right above it is no entry), without headings."""
    near = lines[max(0, at - ABOVE) : at]
    own = near[-1:] + [*takewhile(lambda x: not _is_entry(x), reversed(near[:-1]))]
    return [x for line in reversed(own) if not line.strip().lower().startswith("principal") for x in METRIC_GROUPED.cells(line)]


def in_column(cells: list[float]) -> dict[str, float]:
    """C and C0 by their places in a column of sizes, ratings and speeds: the first speed tells that it is one."""
    speed = next((k for k, x in enumerate(cells) if x >= LEAST_SPEED), 0)
    if speed < SPEED_PLACE or not cells[C_PLACE] > cells[C0_PLACE] > 0:
        return {}
    return {"c_kn": cells[C_PLACE], "c0_kn": cells[C0_PLACE]}


def in_pounds(below: list[str], row: list[float]) -> dict[str, float]:
    """C and C0 as the first two loads in pounds below the designation, else C as the largest number of its row."""
    low, high = POUNDS
    loads = [x for line in below for x in IMPERIAL.cells(line) if low < x < high][:2] or sorted(x for x in row if x > low)[-1:]
    return {k: round(x * LBF_KN, 2) for k, x in zip(("c_kn", "c0_kn"), loads, strict=False)}


def in_row(row: list[float], bore: float | None, known: float | None) -> dict[str, float]:
    """C and C0 as the first neighbours in a row that can be ratings of this bore; else C as the number nearest to a known rating."""
    low, high = CELL_KN
    usable = [x for x in row if low < x < high]
    for c, c0 in pairwise(usable):
        if c > c0 and (not bore or is_plausible(bore, c, "ball")):
            return {"c_kn": c, "c0_kn": c0}
    nearest = min(usable, key=lambda x: abs(x - known), default=None) if known else None
    return {"c_kn": nearest} if nearest is not None and abs(nearest - known) < NEAR_KNOWN * known else {}


def entries(lines: list[str], designation: str, maker: str, known: float | None) -> Iterator[dict[str, float]]:
    """What each line that names the designation tells, by the layout of its maker's catalog."""
    names, bore = names_of(designation), bore_of(designation)
    for at, line in enumerate(lines):
        if not any(n in line.upper() for n in names):
            continue
        row = METRIC.cells(line)
        if len(row) < ROW_CELLS:
            row = column_above(lines, at)
            if pair := in_column(row):
                yield pair | ({"bore_mm": bore} if bore else {})
                continue
        if maker == "REXNORD":
            yield in_pounds(lines[at + 1 : at + 1 + BELOW], row)
        elif maker in ("SKF", "LDK"):
            yield in_row(row, bore, known) | ({"bore_mm": bore} if bore and bore in row else {})


def from_table(text: str, designation: str, maker: str, known: float | None = None) -> dict[str, float]:
    """c_kn, c0_kn, bore_mm as far as the first line tells them that names the designation and tells a rating.

    known: a rating to which a lone number may be matched; none by default.
    """
    return next((x for x in entries(text.split("\n"), designation, maker.upper(), known) if "c_kn" in x), {})


def sentences(kind: str, symbol: str, ahead: bool) -> list[str]:
    """Patterns of one rating in sentences, from parts: a term or a symbol, a separator, a number and its unit; ahead: the number may come before the term."""
    number, unit, sep = r"(\d+\.?\d*)", r"\s*kn", r"\s*[:=]\s*"
    term = rf"{kind}\s+(?:load\s+)?(?:rating|capacity)"
    forms = [rf"{term}[^.]*?{number}{unit}", term + sep + number, rf"\b{symbol}{sep}{number}{unit}"]
    return [*forms, rf"{number}{unit}\s*(?:basic\s+)?{kind}"] if ahead else forms


PROSE = {"c_kn": sentences("dynamic", "C", True), "c0_kn": sentences("static", "C0", False)}


def from_prose(text: str) -> dict[str, float]:
    """c_kn and c0_kn of sentences; of each pattern the first match is tried."""
    low, high = PROSE_KN
    first = {k: [float(m[1]) for p in ps if (m := re.search(p, text, re.I))] for k, ps in PROSE.items()}
    return {k: good[0] for k, xs in first.items() if (good := [x for x in xs if low < x < high])}
