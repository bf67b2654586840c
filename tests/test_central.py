"""Central sentences against a dense walk over all pairs of sentences."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from summarium.operators import central as C
from summarium.operators import shaping as S


def dense_centrality(parts):
    bags = [Counter(re.findall("[a-z0-9]+", s.lower())) for s in parts]
    sf = Counter(w for b in bags for w in b)
    n = len(parts)
    vec = [{w: c * (math.log(n / sf[w]) + 1) for w, c in b.items()} for b in bags]
    size = [math.sqrt(sum(v * v for v in x.values())) for x in vec]
    sim = np.array([[0.0 if i == j or not size[i] or not size[j] else
                     sum(v * vec[j].get(w, 0) for w, v in vec[i].items()) / size[i] / size[j]
                     for j in range(n)] for i in range(n)])
    degree = sim.sum(1)
    step = np.array([sim[i] / degree[i] if degree[i] > 1e-12 else np.full(n, 1 / n) for i in range(n)])
    rank = np.full(n, 1 / n)
    for _ in range(400):
        rank = (1 - C.DAMPING) / n + C.DAMPING * rank @ step
    return rank


def test_walk_equals_the_dense_one(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()]
    for t in texts + ["One two. Two three! Four? one two three four.", "a b. c d. e f.", "Same. Same. Same other."]:
        parts = [s for s in C.sentences(t) if re.search("[a-z0-9]", s.lower())][:60]
        if parts:
            assert np.allclose(C.centrality(parts), dense_centrality(parts), atol=1e-7)


def test_selection_keeps_the_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("article"))
    rows = S.with_constraint_flags(C.central_candidates(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.gen_words <= S.MAX_SUMMARY_WORDS
        if r.repeated_trigrams:  # only where no sentence could be taken
            for s in C.sentences(r.article):
                grams = C._trigrams(s.split())
                assert len(s.split()) > S.MAX_SUMMARY_WORDS or len(set(grams)) < len(grams) \
                    or not re.search("[a-z0-9]", s.lower())
    assert sum(r.len_ok for r in rows) > 0.5 * len(rows)


@pytest.mark.parametrize("text, want", [
    (None, ""), ("", ""), (" \n ", ""), ("... !!! ?", ""), ("Just one.", "Just one."),
    ("w " * 400, " ".join(["w"] * S.MAX_SUMMARY_WORDS)),
    ("The bank rose.\nThe bank fell.\nThe bank rose.", "The bank rose. The bank fell.")])
def test_odd_texts(text, want):
    assert C.central_summary(text) == want


def test_very_many_sentences():
    text = " ".join(f"Word{i % 700} stands by item{i % 31} number {i}." for i in range(12_000))
    got = C.central_summary(text)
    assert S.MIN_SUMMARY_WORDS <= len(got.split()) <= S.MAX_SUMMARY_WORDS
