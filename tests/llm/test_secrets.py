import hashlib
import re

from tests.llm.conftest import ODD
from wearcurve.llm import secrets

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n)


TEXTS = [
    "", None, "token = abc", "token=token:abcdefgh", "password: 'hunter2xx' and PASSWD=\"s3cr3t99\"", "é😀 secret = 0123456789abcdef0123456789abcdef tail", "AKIA" + "A1B2" * 4 + " x AKIASHORT",
    "api_key=zzzzzz apikey:yyyyyyy", "f" * 23 + " " + "f" * 24, "token==abcdef", "tokentoken = \"abcdef\"", "x" * 5000 + " token=abcdefg " + "y" * 5000,
]


def test_base_spans(spark, docs):
    got = {r.doc_id: r for r in secrets.digest(secrets.find_parts(docs(list(enumerate(TEXTS))))).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = base(t)
        told = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in want)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[3] == k for x in want) for k in ("assign", "access", "hex"))
        assert set(told.split(",")) <= set(got[i].spans.split(","))


def spans(spark, docs, text):
    return secrets.digest(secrets.find_parts(docs([(1, text)]))).first().spans


def test_weak_parts_need_their_complements(spark, docs):
    url, user = "https://api.example.com/v1/login", "user_name = alice"
    blob = "aB3" * 12
    assert spans(spark, docs, f"see {url} for {user}") == ""  # no secret
    assert spans(spark, docs, f"text {blob} text") == ""  # nothing beside it
    both = spans(spark, docs, f"{user} pwd: letmein1 at {url}")
    assert [x.split(":")[0] for x in both.split(",")] == ["ident", "weak_assign", "endpoint"]
    far = spans(spark, docs, f"{user} {'x ' * 400} {blob}")
    assert far == ""  # another scope
    assert "blob" in spans(spark, docs, f"AKIA{'A1B2' * 4} {blob}")


def test_many_parts_are_all_linked(spark, docs):
    n = 400
    text = "\n".join(f"user=bob{i:03d} pwd=abcd{i:04d}" for i in range(n))
    got = spans(spark, docs, text).split(",")
    assert sum(x.startswith("ident") for x in got) == n and sum(x.startswith("weak_assign") for x in got) == n


def test_redaction(spark, docs):
    d = docs([(1, 'a token = "abcdefgh" b'), (2, None), (3, ""), (4, "clean")])
    got = {r.doc_id: r for r in secrets.redact(d).collect()}
    assert got[1].text == 'a <assign>" b' and got[2].text is None and got[3].text == "" and got[4].text == "clean"
    assert got[1].parts == "x" and secrets.redact(d).columns == d.columns


def test_odd_rows_and_empty(spark, docs):
    assert secrets.digest(secrets.find_parts(docs(ODD))).count() == len(ODD)
    assert secrets.digest(secrets.find_parts(docs([]))).count() == 0
    plan = secrets.find_parts(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_redaction_of_overlapping_and_many_spans(spark, docs):
    texts = ["".join(f"é😀 token=abcdefg{i:04d} " for i in range(700)) + "tail", "token=" + "0123456789abcdef" * 3 + " AKIA" + "A1B2" * 6 + "secret=abcdefgh;password:zzzzzz", "aB3" * 12 + " user=bob pwd=abcd1234"]
    found = {r.doc_id: [tuple(x) for x in r.parts] for r in secrets.find_parts(docs(list(enumerate(texts)))).select("doc_id", "parts").collect()}
    got = {r.doc_id: r.text for r in secrets.redact(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for s, _, e, kind, *_ in found[i]:
            if s >= at:
                out += t[at:s] + f"<{kind}>"
            at = max(at, e)
        assert got[i] == out + t[at:]


def test_very_many_matches_in_one_text(spark, docs):
    from time import perf_counter

    n = 60_000
    text = " ".join(f"token=abcdefgh{i}" for i in range(n))
    began = perf_counter()
    row = secrets.digest(secrets.find_parts(docs([(1, text)]))).first()
    assert row.n_assign == n and row.spans.count(",") == n - 1 and len(secrets.redact(docs([(1, text)])).first().text) == n * 8 + n - 1
    assert perf_counter() - began < 120
