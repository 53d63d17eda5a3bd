import random

from tests.llm.conftest import ODD
from wearcurve.llm import licenses

RNG = random.Random(4)


def noise(n):
    return " ".join(RNG.choice(["the", "of", "and", "to", "in", "xx", "yy", "zz", "software", "license"]) for _ in range(n))


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        diag = 0
        for j, b in enumerate(y):
            diag, row[j + 1] = row[j + 1], diag + 1 if a == b else max(row[j], row[j + 1])
    return row[-1]


def test_patience_against_common_subsequences():
    for k in range(200):
        x = [RNG.randrange(12) for _ in range(RNG.randrange(0, 30))]
        y = [RNG.randrange(12) for _ in range(RNG.randrange(0, 30))]
        got = licenses.patience(x, y)
        assert all(x[i] == y[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
        assert len(got) <= lcs(x, y)
    z = list(range(50))
    assert len(licenses.patience(z[:20] + [99] + z[20:], z)) == 50


def test_planted_templates(spark, docs):
    rows, want = [], set()
    for k, (license, name, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 20:
            for _ in range(len(words) // 12):
                words[RNG.randrange(len(words))] = "changed"
        rows.append((k, f"{noise(60)}\n{' '.join(words)}\n{noise(60)}"))
        want.add((k, license))
    rows += [(100 + k, noise(300)) for k in range(10)]
    rows.append((200, " ".join([licenses.TEMPLATES[1][2]] * 3)))
    got = licenses.scan(docs(rows)).collect()
    assert want <= {(r.doc_id, r.license) for r in got}
    assert not [r for r in got if 100 <= r.doc_id < 200]
    assert sum(r.doc_id == 200 for r in got) == 3
    text = dict(rows)
    one = next(r for r in got if r.doc_id == 2 and r.template == "line")
    assert text[2].encode()[one.start_byte : one.end_byte].decode() == licenses.TEMPLATES[2][2].rstrip(".")


def test_long_template_among_many_words(spark, docs):
    mit = next(t for license, name, t in licenses.TEMPLATES if (license, name) == ("MIT", "text"))
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    got = licenses.scan(docs([(1, mit), (2, half), (3, f"{noise(5000)} {mit.upper()} {noise(5000)}")])).collect()
    assert {r.doc_id for r in got if r.license == "MIT"} == {1, 3}
    assert next(r for r in got if r.doc_id == 1).coverage == 1.0


def test_odd_rows_and_empty(spark, docs):
    assert licenses.scan(docs(ODD)).count() == 0
    assert licenses.scan(docs([])).count() == 0
    assert licenses.scan(docs([(None, licenses.TEMPLATES[1][2])])).first().license == "MIT"


def test_every_kind_of_notice_is_found(spark, docs):
    got = {r.doc_id: r.license for r in licenses.scan(docs([(k, f"word {t} word") for k, (_, _, t) in enumerate(licenses.TEMPLATES)])).collect()}
    assert got == {k: license for k, (license, _, _) in enumerate(licenses.TEMPLATES)}
    assert {"All-Rights-Reserved", "BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"} <= set(got.values())


def test_one_license_for_one_notice(spark, docs):
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    cc = "This work is licensed under the Creative Commons {} {} International License."
    want = {
        "Licensed under CC BY 4.0": ["CC-BY-4.0"], "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"], "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "Licensed under CC BY-NC-ND 4.0": ["CC-BY-NC-ND-4.0"],
        gnu.format("", 2): ["GPL-2.0"], gnu.format("", 3): ["GPL-3.0"], gnu.format("Lesser ", 3): ["LGPL-3.0"], gnu.format("", 7): [], gnu.format("Library ", 2): [],
        cc.format("Attribution", "4.0"): ["CC-BY-4.0"], cc.format("Attribution-ShareAlike", "4.0"): ["CC-BY-SA-4.0"], cc.format("Attribution", "3.0"): [], "Released under the ZIB License.": [],
        "Licensed under CC BY 4.0. Released under the MIT License. All rights reserved.": ["All-Rights-Reserved", "CC-BY-4.0", "MIT"],
    }
    got = {}
    for r in licenses.scan(docs(list(enumerate(want)))).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {k: sorted(got.get(k, [])) for k in range(len(want))} == dict(enumerate(want.values()))
