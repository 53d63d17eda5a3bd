"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from wearcurve.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([r[c] for c in names]) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    r = duck.execute(catalogue.ORACLES[name])
    have = [x[0] for x in r.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert got == sorted(repr([row[i] for i in at]) for row in r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_corpus_operators(tmp_path, pipeline):
    """With corpus_pipeline.py gone too, and with it left behind."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "wearcurve", tmp_path / "wearcurve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    if pipeline:
        if not (top / "corpus_pipeline.py").exists():
            pytest.skip("it is gone")
        shutil.copy(top / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pid_metrics' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
