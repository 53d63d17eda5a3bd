"""License scan by patience alignment with license templates.

A template's words are looked for in windows of twice its length. In a window, words unique to both the window and the template
are anchors; the longest increasing run of their places is kept, and the gaps between them are aligned in the same way. A gap
without anchors is matched by its common head and tail, then by a longest common subsequence. Coverage is the share of the template's words
that are matched. Only windows with enough of the template's words are aligned, by bounds that no match of the
asked coverage can miss. After a match the search goes on behind it. A match must hold the words that tell its license from others (TELLING), and
none that tell another; of matches that share most of their words, the one with the most matched words is kept (of those, that of higher coverage).
Licenses without their full text here are found by their notices and by the opening of their texts.

Words are lower-cased (A-Z) and rid of ASCII punctuation.

Defined results: null or empty texts have no match; null doc_ids are kept; repeated rows are told each; other columns aren't read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcurve.llm.kernels import PUNCTUATION, Words, chunks

COVERAGE = 0.8
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {name}General Public License for more details."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_FREEDOM = "The licenses for most software are designed to take away your freedom to share and change it. By contrast,"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: The public texts of licenses and of the usual notices. (license, name of the template, text)
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "line", "Released under the MIT License."),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "Apache-2.0",
        "notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "GPL-3.0",
        "notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("All-Rights-Reserved", "line", "All rights reserved."),
    ("GPL-2.0", "line", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "line", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "line", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "line", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "line", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "line", "Released under the BSD 3-Clause License."),
    *[(f"CC-{kind}-4.0", "line", f"Licensed under CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    *[
        (f"CC-{kind}-4.0", "notice", f"This work is licensed under the Creative Commons {name} 4.0 International License.")
        for kind, name in (("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    ],
    *[(f"{kind}-{version}", "notice", _GNU.format(name=name, version=version.removesuffix(".0"))) for kind, name, version in (("GPL", "", "2.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0"))],
    ("BSD-2-Clause", "text", _BSD.format(third="")),
    ("BSD-3-Clause", "text", _BSD.format(third="Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    (
        "Apache-2.0",
        "head",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ),
    *[
        (f"{kind}-{version}", "head", f"GNU {name}GENERAL PUBLIC LICENSE Version {version.removesuffix('.0')}, {date} Copyright (C) Free Software Foundation, Inc. {_VERBATIM} {more}")
        for kind, name, version, date, more in (
            ("GPL", "", "2.0", "June 1991", f"Preamble {_FREEDOM} the GNU General Public License is intended to guarantee your freedom to share and change free software"),
            ("GPL", "", "3.0", "29 June 2007", "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
            ("LGPL", "LESSER ", "2.1", "February 1999", f"This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1. Preamble {_FREEDOM} the GNU General Public Licenses are intended to guarantee your freedom"),
            ("LGPL", "LESSER ", "3.0", "29 June 2007", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
            ("AGPL", "AFFERO ", "3.0", "19 November 2007", "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
        )
    ],
    ("MPL-2.0", "head", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
]
#: Of a license: words that a match must hold (those that its template has; one of those between bars), and words that it must not hold, which tell other licenses.
_OTHER_CC = {"BY": ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives"), "BY-SA": ("nc", "nd", "noncommercial", "noderivatives"), "BY-ND": ("nc", "sa", "noncommercial", "sharealike"), "BY-NC": ("sa", "nd", "sharealike", "noderivatives"), "BY-NC-SA": ("nd", "noderivatives"), "BY-NC-ND": ("sa", "sharealike")}
TELLING: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Apache-2.0": (("apache", "2", "0"), ()),
    "MIT": (("mit",), ()),
    "GPL-2.0": (("general", "public", "2|1991"), ("lesser", "library", "affero")),
    "GPL-3.0": (("general", "public", "3|2007"), ("lesser", "library", "affero")),
    "LGPL-2.1": (("lesser", "general", "public", "2|1999", "1|1999"), ("affero",)),
    "LGPL-3.0": (("lesser", "general", "public", "3|2007"), ("affero",)),
    "AGPL-3.0": (("affero", "general", "public", "3|2007"), ("lesser",)),
    "MPL-2.0": (("mozilla", "2", "0"), ()),
    "BSD-2-Clause": (("bsd", "2", "clause", "binary"), ("endorse",)),
    "BSD-3-Clause": (("bsd", "3", "clause", "endorse"), ("advertising",)),
    **{f"CC-{kind}-4.0": (("cc", "by", "nc", "sa", "nd", "commons", "attribution", "noncommercial", "sharealike", "noderivatives", "4", "0"), other) for kind, other in _OTHER_CC.items()},
}


def _lcs(x: list, y: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places: the longest rising run of all pairs of equal words. Its memory is that of the pairs."""
    where: dict = {}
    for j in range(len(y) - 1, -1, -1):  # falling, so that no two pairs of one place in x rise
        where.setdefault(y[j], []).append(j)
    return _rising([(i, j) for i, w in enumerate(x) for j in where.get(w, ())])


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ordered by the first) whose seconds increase."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = ends[p - 1] if p else -1
        tops[p : p + 1] = [j]
        ends[p : p + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(x: list, y: list) -> list[tuple[int, int]]:
    """Matched places (in x, in y), both increasing."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(x[a:b]).items() if n == 1} & {w for w, n in Counter(y[c:d]).items() if n == 1}
        if not once:
            out += [(a + i, c + j) for i, j in _lcs(x[a:b], y[c:d])]
            continue
        where = {w: j for j, w in enumerate(y[c:d], c) if w in once}
        anchors = _rising([(i, where[w]) for i, w in enumerate(x[a:b], a) if w in once])
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Template:
    def __init__(self, license: str, text: str, coverage: float):
        self.words = Words(pa.array([text]), PUNCTUATION).hash
        self.list, self.vocabulary = self.words.tolist(), np.unique(self.words)
        self.m = len(self.words)
        self.need = max(1, math.ceil(coverage * self.m))
        self.distinct = max(1, len(self.vocabulary) - (self.m - self.need))
        needs, without = TELLING.get(license, ((), ()))
        hashes = lambda words: set(Words(pa.array([words]), PUNCTUATION).hash.tolist())
        self.needs = [own for x in needs if (own := hashes(x) & set(self.list))]  # bars are punctuation
        self.without = hashes(" ".join(without)) - set(self.list)

    def told(self, found: list[tuple[int, int]]) -> bool:
        seen = {self.list[y] for _, y in found}
        return all(seen & x for x in self.needs)

    def matches(self, h: np.ndarray, places: np.ndarray) -> Iterator[tuple[list[int], int, int]]:
        """(places of the matched words, first word, end) in the words h of one text, of which those at places are in the vocabulary."""
        span, k = 2 * self.m, self.need
        starts = places[: len(places) - k + 1][places[k - 1 :] - places[: len(places) - k + 1] < span]
        i = 0
        while i < len(starts):
            s = int(starts[i])
            window = h[s : s + span]
            if len(np.intersect1d(window, self.vocabulary)) >= self.distinct:
                found = patience(window.tolist(), self.list)
                first, end = (s + found[0][0], s + found[-1][0] + 1) if found else (s, s)
                if len(found) >= self.need and self.told(found) and not self.without.intersection(h[first:end].tolist()):
                    yield [s + x for x, _ in found], first, end
                    i = int(np.searchsorted(starts, end))
                    continue
            i += 1


def _best(found: list[tuple[list[int], float, int, int, int]]) -> list[tuple[list[int], float, int, int, int]]:
    """Of matches in one text (places, coverage, template, first, end): without those of which a better one has at least half of the matched words."""
    kept, taken = [], []
    for x in sorted(found, key=lambda x: (-len(x[0]), -x[1], x[2], x[3])):
        own = set(x[0])
        if all(2 * len(own & t) < len(own) for t in taken):
            kept.append(x)
            taken.append(own)
    return kept


def scan(df: DataFrame, coverage: float = COVERAGE, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """doc_id, license, template, coverage, start_word, end_word, start_byte, end_byte (of the UTF-8 text): one row per match."""
    named = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Template(license, t, coverage) for license, _, t in named]
        vocabulary = np.unique(np.concatenate([t.vocabulary for t in made]))
        table = np.zeros(1 << 16, bool)
        table[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            for i, j in chunks(batch.column("text")):
                w = Words(batch.column("text").slice(i, j - i), PUNCTUATION)
                maybe = np.flatnonzero(table[(w.hash >> np.uint64(48)).astype(np.int64)])
                word = np.searchsorted(vocabulary, w.hash[maybe]).clip(max=len(vocabulary) - 1)
                known = vocabulary[word] == w.hash[maybe]
                maybe, word = maybe[known], word[known]
                found: dict[int, list] = {}
                for k, t in enumerate(made):
                    places = maybe[np.isin(vocabulary, t.vocabulary)[word]]
                    if len(places) < t.need:
                        continue
                    a, b = places[: len(places) - t.need + 1], places[t.need - 1 :]
                    for d in np.unique(w.doc[a[(b - a < 2 * t.m) & (w.doc[a] == w.doc[b])]]).tolist():
                        lo, hi = int(w.first[d]), int(w.first[d + 1])
                        own = places[np.searchsorted(places, lo) : np.searchsorted(places, hi)] - lo
                        for at, first, end in t.matches(w.hash[lo:hi], own):
                            found.setdefault(d, []).append((at, len(at) / t.m, k, first, end))
                out = []
                for d, matches in found.items():
                    lo = int(w.first[d])
                    out += [(d, *named[k][:2], share, first, end, int(w.starts[lo + first] - w.offsets[d]), int(w.ends[lo + end - 1] - w.offsets[d])) for _, share, k, first, end in _best(matches)]
                if out:
                    cols = list(zip(*sorted(out), strict=True))
                    kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(cols[0])), *[pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]], names=["doc_id", "license", "template", "coverage", "start_word", "end_word", "start_byte", "end_byte"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, template string, coverage double, start_word long, end_word long, start_byte long, end_byte long")
