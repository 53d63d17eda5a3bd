import random
import re


from tests.llm.conftest import ODD
from wearcurve.llm import quality


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), sum(a == b for a, b in zip(words, words[1:]))


def check(spark, docs, rows):
    got = quality.ledger(docs(rows), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_stutters) == measured(r.text), r.text[:60]


def test_measures_equal_brute_force(spark, docs):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        words = [rng.choice(["a", "b", "cc", "d#", "é", "|"]) for _ in range(rng.choice([0, 3, 8, 9, 16, 40, 200]))]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words)))
    check(spark, docs, rows)


def test_odd_rows(spark, docs):
    check(spark, docs, ODD)


def test_policies_and_ablation(spark, docs):
    clean = " ".join(f"word{i} text" for i in range(40))
    rows = [(1, clean), (2, "short"), (3, clean.upper()), (4, " ".join(f"w{i}###" for i in range(30))), (5, "same " * 50)]
    scored = quality.ledger(docs(rows))
    kept = {r.doc_id: r.kept for r in quality.apply_policy(scored).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r.doc_id for r in quality.apply_policy(scored, "base").where("kept").collect()} == {1, 3, 4}
    told = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(scored).collect()}
    bits = {r.doc_id: r.failed_bits for r in scored.collect()}
    for k, name in enumerate(quality.RULES):
        failed = [b for b in bits.values() if b >> k & 1]
        assert told[name] == (len(failed), sum(b == 1 << k for b in failed))


def test_empty_table(spark, docs):
    assert quality.ledger(docs([])).count() == 0


def test_native_plan(spark, docs):
    plan = quality.ledger(docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
