import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A factory: documents of (doc_id, text) with clashing and extra columns."""

    def make(rows, extra=True):
        d = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("parts", "_text", "_words", "kept", "component_id", "shard", "slot", "size", "bucket", "key", "row", "n_words", "hash", "template", "host"):
                d = d.withColumn(c, F.lit("x"))
        return d

    return make


LONG = "alpha beta gamma delta " * 20_000
ODD = [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, LONG), (5, LONG), (None, "null id here with some words"), (6, "naïve café 😀 text"), (6, "naïve café 😀 text")]
