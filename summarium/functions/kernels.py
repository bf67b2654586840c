"""Per-row kernels with no Spark built-in, as Arrow UDFs.

Each kernel is a small pure-Python helper applied to one row's arrays; Spark
partitions the rows, Arrow moves them in column batches.  Of a batch only
``PIECE`` rows at a time stand as Python objects, which take several times the
room of the batch itself; so a worker's memory is that of a few batches,
whatever the number of rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that stand as Python objects together.
PIECE = 256


def as_lists(column: pa.Array) -> list:
    """The values of a column; those of an array column as lists, by one conversion."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    at = column.offsets.to_pylist()
    flat = column.values.slice(at[0], at[-1] - at[0])
    flat = flat.to_pylist() if flat.null_count else flat.to_numpy(zero_copy_only=False).tolist()
    return [flat[i - at[0]:j - at[0]] if ok else None
            for i, j, ok in zip(at, at[1:], column.is_valid().to_pylist())]


def pieces(columns, size: int = PIECE) -> Iterator[list[list]]:
    """The columns of a batch as Python values, ``size`` rows at a time."""
    for at in range(0, len(columns[0]), size):
        yield [as_lists(c.slice(at, size)) for c in columns]


def by_pieces(kernel: Callable[..., list], kind: pa.DataType, *columns: pa.Array, size: int = PIECE) -> pa.Array:
    """A kernel from lists of values to a list of results, over a batch of any size."""
    return pa.concat_arrays([pa.array([], kind)] + [pa.array(kernel(*part), kind) for part in pieces(columns, size)])


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token sequences.

    Bit-parallel formulation (Allison & Dix 1986; Hyyro 2004): one machine-word
    (here: Python int) update per token of ``a``, so O(|a| * |b| / 64) instead
    of the O(|a| * |b|) dynamic programme, with identical results.
    """
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    for i, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def tf_cosine(a, b) -> float:
    """Cosine of the term-frequency vectors of two token sequences
    (0.0 when either is empty)."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0.0
    ca, cb = Counter(a), Counter(b)
    dot = sum(v * cb.get(k, 0) for k, v in ca.items())
    na = math.sqrt(sum(v * v for v in ca.values()))
    nb = math.sqrt(sum(v * v for v in cb.values()))
    return dot / (na * nb)


@F.arrow_udf(T.DoubleType())
def tf_cosine_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return by_pieces(lambda xs, ys: [None if x is None or y is None else tf_cosine(x, y) for x, y in zip(xs, ys)],
                     pa.float64(), a, b)


TOKEN_COUNTS_TYPE = T.ArrayType(T.StructType([T.StructField("tok", T.StringType()), T.StructField("ta", T.IntegerType()),
                                              T.StructField("tb", T.IntegerType())]))
_TOKEN_COUNTS = pa.list_(pa.struct([("tok", pa.string()), ("ta", pa.int32()), ("tb", pa.int32())]))


def token_counts(a: list[str], b: list[str]) -> list[tuple]:
    """(token, count in a, count in b) of the distinct tokens of two sequences."""
    ca, cb = Counter(a), Counter(b)
    return [(t, ca[t], cb[t]) for t in ca | cb]


@F.arrow_udf(TOKEN_COUNTS_TYPE)
def token_counts_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return by_pieces(lambda xs, ys: [token_counts(x, y) for x, y in zip(xs, ys)], _TOKEN_COUNTS, a, b)


def ngram_counts(tokens, n: int) -> Counter:
    if n == 1:
        return Counter(tokens)
    return Counter(zip(*(tokens[i:] for i in range(n))))


def clipped_overlap(a, b, n: int) -> int:
    """sum over n-grams g of min(count_a g, count_b g)."""
    ca, cb = ngram_counts(a, n), ngram_counts(b, n)
    if len(cb) < len(ca):
        ca, cb = cb, ca
    return sum(min(v, cb.get(k, 0)) for k, v in ca.items())


ROUGE_COUNTS_TYPE = T.StructType([T.StructField("o1", T.IntegerType()),
                                  T.StructField("o2", T.IntegerType()),
                                  T.StructField("lcs", T.IntegerType())])


_COUNTS = pa.struct([("o1", pa.int32()), ("o2", pa.int32()), ("lcs", pa.int32())])


def _rouge_counts(orders: tuple, want_lcs: bool):
    def counts(r, g) -> tuple:
        if r is None or g is None:
            return None, None, None
        return (clipped_overlap(r, g, 1) if 1 in orders else None,
                clipped_overlap(r, g, 2) if 2 in orders else None,
                lcs_length(r, g) if want_lcs else None)

    @F.arrow_udf(ROUGE_COUNTS_TYPE)
    def rouge_counts(ref: pa.Array, gen: pa.Array) -> pa.Array:
        return by_pieces(lambda rs, gs: [counts(r, g) for r, g in zip(rs, gs)], _COUNTS, ref, gen)
    return rouge_counts


_ROUGE_UDFS: dict = {}


def rouge_counts_udf(orders=(1, 2), want_lcs: bool = True):
    """Arrow UDF: (reference tokens, candidate tokens) -> struct(o1, o2, lcs)
    with the clipped unigram / bigram overlaps and the LCS length.  One call
    per row computes every requested count, so tokens cross Arrow once."""
    key = (tuple(sorted(orders)), want_lcs)
    if key not in _ROUGE_UDFS:
        _ROUGE_UDFS[key] = _rouge_counts(*key)
    return _ROUGE_UDFS[key]


ENTITY_ARRAY_TYPE = T.ArrayType(T.StructType([T.StructField("ent_type", T.StringType()),
                                              T.StructField("ent_text", T.StringType())]))
_ENTITIES = pa.list_(pa.struct([("ent_type", pa.string()), ("ent_text", pa.string())]))


def gazetteer_mentions(text: str, token_re, terms: dict, max_words: int, distinct: bool) -> list:
    """(type, text) for every type of every word n-gram whose lower case is a
    gazetteer term: unigrams first, then bigrams, ... in text order; ``distinct``
    keeps the first occurrence of each (type, text)."""
    toks = token_re.findall(text)
    out, seen = [], set()
    for n in range(1, max_words + 1):
        for i in range(len(toks) - n + 1):
            g = toks[i] if n == 1 else " ".join(toks[i:i + n])
            for t in terms.get(g.lower(), ()):
                if distinct:
                    if (t, g) in seen:
                        continue
                    seen.add((t, g))
                out.append({"ent_type": t, "ent_text": g})
    return out


def gazetteer_udf(terms: dict, max_words: int, token_pattern: str, distinct: bool):
    """Arrow UDF: text -> array<struct<ent_type, ent_text>> of gazetteer
    mentions.  ``terms`` (lower-case term -> types) travels with the function."""
    import re
    token_re = re.compile(token_pattern)

    @F.arrow_udf(ENTITY_ARRAY_TYPE)
    def mentions(texts: pa.Array) -> pa.Array:
        return by_pieces(lambda ts: [None if t is None else gazetteer_mentions(t, token_re, terms, max_words, distinct)
                                     for t in ts], _ENTITIES, texts)
    return mentions
