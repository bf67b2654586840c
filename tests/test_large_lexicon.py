"""Lexicons of many terms: the automaton against scans term by term."""

import random
import time

import pytest
from pyspark.sql import functions as F

from summarium.functions import lexicon as L
from summarium.operators import losses as LS


def overlapping_terms(n, seed=1):
    draw = random.Random(seed)
    out = set()
    while len(out) < n:
        out.add("".join(draw.choices("abc d", k=draw.randrange(1, 14))).strip() or "a")
    return sorted(out)


def texts(n=25, seed=2):
    draw = random.Random(seed)
    return ["".join(draw.choices("abc D", k=draw.choice([0, 5, 200, 2000]))) for _ in range(n)] + [None, "", "é a"]


@pytest.mark.parametrize("match", ["substring", "word"])
@pytest.mark.parametrize("as_table", [False, True])
def test_twenty_thousand_overlapping_terms(spark, match, as_table):
    terms = overlapping_terms(20_000)
    df = spark.createDataFrame(list(enumerate(texts())), "i long, t string")
    lexicon = spark.createDataFrame([(t.upper(),) for t in terms + terms[:50]] + [(None,), ("",)],
                                    "term string") if as_table else terms
    for i, t, got in LS.with_terms(df, {"t": "terms"}, match, lexicon).collect():
        low = (t or "").lower()
        if match == "word":
            low = " " + " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in low).split()) + " "
            want = [x for x in terms if f" {x} " in low]
        else:
            want = [x for x in terms if x in low]
        assert got == want


@pytest.mark.parametrize("match", ["substring", "word"])
def test_few_terms_are_found_alike(spark, monkeypatch, match):
    df = spark.createDataFrame(list(enumerate(texts())), "i long, t string")
    terms = overlapping_terms(40)
    few = LS.with_terms(df, {"t": "x"}, match, terms).collect()
    monkeypatch.setattr(LS, "SCAN_TERMS", 0)
    assert LS.with_terms(df, {"t": "x"}, match, terms).collect() == few
    assert all(r.x == [] for r in LS.with_terms(df, {"t": "x"}, match, []).collect())


def test_fixed_lexicon_equals_itself_by_automaton(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("t"))
    plain = LS.with_terms(docs, {"t": "x"}).select("doc_id", "x")
    L_terms = L.LEXICON_TERMS + ["no such term %d" % i for i in range(L.SCAN_TERMS)]
    both = LS.with_terms(docs, {"t": "x"}, lexicon=L_terms).select("doc_id", "x")
    assert plain.exceptAll(both).count() == 0 and both.exceptAll(plain).count() == 0


def test_a_pass_does_not_grow_with_the_lexicon():
    """The same hits in a lexicon a hundred times as long take about the same time."""
    text = "abc abd xyz " * 20_000
    took = []
    for n in (200, 20_000):
        terms = ["abd xyz"] + [f"term {i:06d}" for i in range(n)]
        automaton = L.build_automaton(terms)
        t = time.perf_counter()
        for _ in range(5):
            assert L.find_terms(automaton, terms, text) == ["abd xyz"]
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0]


def test_lexicon_over_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "LEXICON_BYTES", 10)
    with pytest.raises(ValueError):
        L.lexicon_terms(spark.createDataFrame([("abcdef",), ("ghijkl",)], "term string"))
