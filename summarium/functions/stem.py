"""Porter stemmer (Porter 1980, "An algorithm for suffix stripping").

The ROUGE scorer stems tokens longer than three characters.  The stemmer is a
per-token helper; Spark applies it either per row through an Arrow UDF with a
memo (``stem_tokens``) or once per distinct vocabulary entry
(``stem_vocabulary``), which is what makes the cost scale with the
vocabulary rather than the corpus.

This is the original 1980 rule set.  Libraries that add their own extensions
to it (irregular forms, special cases for short words) can stem a minority of
words differently.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import by_pieces

MIN_STEM_LEN = 4          # tokens of 3 characters or fewer are left as they are

_VOWELS = frozenset("aeiou")


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        cons = _is_cons(stem, i)
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2) and _is_cons(w, len(w) - 1)
            and w[-1] not in "wxy")


# The suffix rules of steps 2-4 (longer suffixes first where
# one ends another, so the first match is the longest).
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _rules(w: str, rules, min_m: int) -> str:
    for suf, rep in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if _measure(stem) > min_m else w
    return w


def _step1ab(w: str) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
        return w
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[: -len(suf)]):
            w = w[: -len(suf)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double_cons(w) and w[-1] not in "lsz":
                return w[:-1]
            if _measure(w) == 1 and _cvc(w):
                return w + "e"
            return w
    return w


def _step4(w: str) -> str:
    for suf in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if suf == "ion" and not stem.endswith(("s", "t")):
                return w
            return stem if _measure(stem) > 1 else w
    return w


@lru_cache(maxsize=1 << 20)
def porter_stem(word: str) -> str:
    """Stem one lower-case word."""
    if len(word) <= 2:
        return word
    w = _step1ab(word)
    if w.endswith("y") and _has_vowel(w[:-1]):                      # step 1c
        w = w[:-1] + "i"
    w = _rules(w, STEP2, 0)
    w = _rules(w, STEP3, 0)
    w = _step4(w)
    if w.endswith("e"):                                              # step 5a
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):      # step 5b
        w = w[:-1]
    return w


def rouge_stem(token: str) -> str:
    return porter_stem(token) if len(token) >= MIN_STEM_LEN else token


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Arrow UDF: stem every token of a token array (memoised per worker)."""
    return by_pieces(lambda rows: [None if t is None else [rouge_stem(x) for x in t] for t in rows],
                     pa.list_(pa.string()), tokens)


def stem_vocabulary(tokens: DataFrame, col: str = "token") -> DataFrame:
    """``(token, stem)`` for the distinct tokens of ``tokens[col]``.

    The distinct step shuffles each token once per map partition (partial
    aggregation), and the stemmer then runs once per vocabulary entry.
    """
    vocab = tokens.select(col).filter(F.col(col).isNotNull()).distinct()

    def stem_batches(batches):
        for pdf in batches:
            yield pd.DataFrame({col: pdf[col], "stem": [rouge_stem(t) for t in pdf[col]]})

    return vocab.mapInPandas(stem_batches, f"{col} string, stem string")


def stemmed(tokens: Column) -> Column:
    return stem_tokens(tokens)
