import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Build a documents table from (doc_id, text[, source]) rows, with extra columns
    whose names clash with those the operators use inside."""
    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("id", "th", "name", "block", "w", "label", "seed", "size", "pos"):
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make


LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(12_000))
#: Nulls, empty and blank texts, one word, a very long text, repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "Ünï côdé 文字 \U0001f600 ok"),
       (7, "same row"), (7, "same row"), (None, "no id here"), (8, None, None)]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
