"""The machine's scoring identity, held-out accuracy and odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from summarium.llm import quality_fm as Q


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = Q.Machine((), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    idx, val = [2, 5, 9, 11, 29], rng.normal(size=5)
    z = m.bias + sum(m.linear[i] * v for i, v in zip(idx, val))
    for (i, v), (j, w) in itertools.combinations(list(zip(idx, val)), 2):
        z += m.factors[i] @ m.factors[j] * v * w
    assert m.score([(idx, list(val))])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_accuracy_and_fold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    big_labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = Q.fit(big, big_labels)
    rows = (big.select("doc_id", Q.held_out().alias("h"), Q.score_documents(big, m).alias("score"))
               .join(big_labels, "doc_id").collect())
    for r in rows:
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.h]
    right = sum((r.score >= Q.THRESHOLD) == (r.quality == 1) for r in held)
    assert right / len(held) >= 0.95
    ids = Q.training_ids(labels, most=20)
    assert 0 < ids.count() < 60 and ids.where(Q.held_out()).count() == 0
    assert docs.count()


def test_without_both_classes_and_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = Q.fit(odd_docs, none)
    scores = [r.s for r in odd_docs.select(Q.score_documents(odd_docs, m).alias("s")).collect()]
    assert len(scores) == odd_docs.count() and all(s == pytest.approx(0.5) for s in scores)
    assert no_docs.select(Q.score_documents(no_docs, m).alias("s")).count() == 0
    two = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0), (2, None, 0)],
                                "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in Q.training_ids(two).collect()} <= {4, 5, 6}
    m = Q.fit(odd_docs.drop("n_chars"), two)
    assert odd_docs.where(Q.score_documents(odd_docs, m).between(0, 1)).count() == odd_docs.count()


def test_features_are_sorted_and_bounded():
    for t in (None, "", "a b A", "x" * 5000, "!!! ### ||| \n\n", "é 文"):
        for meta in ((None,), (float("nan"),), (-5.0,), (1e18,)):
            idx, val = Q.featurise(t, meta)
            assert idx == sorted(set(idx)) and max(idx) < Q.dimension(("n_chars",)) and len(idx) == len(val)


def test_score_does_not_read_labels_or_names(spark, make_docs):
    df = make_docs([(1, "some text here", "a"), (2, "some text here", "b")])
    m = Q.Machine(("n_chars",), 0.0, np.linspace(-1, 1, Q.dimension(("n_chars",))),
                  np.ones((Q.dimension(("n_chars",)), 2)))
    s = [r.s for r in df.withColumn("lang", F.col("source")).select(Q.score_documents(df, m).alias("s")).collect()]
    assert s[0] == s[1]
