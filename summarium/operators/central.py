"""Extractive candidates by sentence centrality.

The sentences of an article are the nodes of a graph whose edges are the cosines of their
tf-idf vectors (idf over the article's sentences).  A random walk on it, with ``DAMPING``,
ranks the sentences; they are taken in that order, leaving out those that would repeat a
word trigram of the candidate or pass ``MAX_SUMMARY_WORDS``, until ``MIN_SUMMARY_WORDS`` are reached, and
joined in text order.

The graph is never written out: with X the sparse sentence-term matrix, a step of the walk
is X (X' r), so the cost of a step is the number of distinct words of the sentences and a
text of very many sentences has no square.  A row is one article, so nothing is shuffled.

Defined cases: a null or empty text gives an empty candidate; sentences without words
(signs only) are never taken; equal ranks go to the earlier sentence; where the most
central sentence alone is too long, its first ``MAX_SUMMARY_WORDS`` words are taken; a text
of fewer words than ``MIN_SUMMARY_WORDS`` gives what it has.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shaping import MAX_SUMMARY_WORDS, MIN_SUMMARY_WORDS
from ..functions.text import word_count

DAMPING = 0.85
STEPS = 100
CLOSE = 1e-10
#: Decimals to which ranks are compared.
RANK_DIGITS = 9
SYSTEM, MODEL_ID = "Central", "extractive/central-sentences"

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TOKEN = re.compile("[a-z0-9]+")


def sentences(text: str | None) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text or "") if s and s.strip()]


def centrality(parts: list[str]) -> np.ndarray:
    """Stationary weights of the walk over the sentences."""
    n = len(parts)
    counts = [Counter(_TOKEN.findall(s.lower())) for s in parts]
    number: dict[str, int] = {}
    for c in counts:
        for w in c:
            number.setdefault(w, len(number))
    row = np.repeat(np.arange(n), [len(c) for c in counts])
    col = np.fromiter((number[w] for c in counts for w in c), np.int64, len(row))
    tf = np.fromiter((v for c in counts for v in c.values()), np.float64, len(row))
    held = np.bincount(col, minlength=len(number))
    x = tf * (np.log(n / held[col]) + 1)
    norm = np.sqrt(np.bincount(row, x * x, minlength=n))
    x = x / norm[row]
    own = (norm > 0).astype(float)

    def similar(r: np.ndarray) -> np.ndarray:
        """Sums of r over the other sentences, weighted by cosine."""
        terms = np.bincount(col, x * r[row], minlength=len(number))
        return np.bincount(row, x * terms[col], minlength=n) - own * r

    degree = similar(np.ones(n))
    linked = degree > 1e-12
    rank = np.full(n, 1 / n)
    for _ in range(STEPS):
        out = np.where(linked, rank / np.where(linked, degree, 1), 0.0)
        new = (1 - DAMPING) / n + DAMPING * (similar(out) + rank[~linked].sum() / n)
        done = np.abs(new - rank).sum() < CLOSE
        rank = new
        if done:
            break
    return rank


def _trigrams(words: list[str]) -> list[tuple]:
    return list(zip(words, words[1:], words[2:]))


def central_summary(text: str | None, least: int = MIN_SUMMARY_WORDS, most: int = MAX_SUMMARY_WORDS) -> str:
    parts = [s for s in sentences(text) if _TOKEN.search(s.lower())]
    if not parts:
        return ""
    rank = np.round(centrality(parts), RANK_DIGITS)
    order = sorted(range(len(parts)), key=lambda i: (-rank[i], i))
    split = [s.split() for s in parts]
    chosen: list[int] = []
    words: list[str] = []
    for i in order:
        if len(words) >= least:
            break
        if len(words) + len(split[i]) <= most:
            more = sorted([*chosen, i])
            joined = [w for j in more for w in split[j]]
            grams = _trigrams(joined)
            if len(set(grams)) == len(grams):
                chosen, words = more, joined
    return " ".join(words or split[order[0]][:most])


@F.pandas_udf(T.StringType())
def _central_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([central_summary(t) for t in texts], dtype="object")


def central_candidates(docs: DataFrame, text: str = "article") -> DataFrame:
    """The articles with the candidate of the system ``Central``, as
    ``shaping.extractive_candidates`` gives them for span systems."""
    return docs.withColumns({"system": F.lit(SYSTEM), "model_id": F.lit(MODEL_ID),
                             "generated": _central_udf(F.col(text)), "source_words": word_count(text)})
