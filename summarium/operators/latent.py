"""Latent semantic similarity (E6, E13): a randomised truncated SVD of the term matrix.

Rows of the matrix A are texts, columns are ``BUCKETS`` hashed tokens, entries are tf-idf
with rows of length 1.  A random block of rank + ``EXTRA`` columns is multiplied by A'A
``PASSES`` times and made orthonormal in between, which turns it to the leading right
singular vectors; the small matrix V' A'A V gives the values and the last turn.

Scale: the texts are tokenised once and staged as token buckets; a pass over them is one
job, in which a task adds up its part of A'(A V) and hands on blocks of it, summed by
block.  What the driver and each task hold is BUCKETS x (rank + EXTRA) numbers, by the
parameters 1.6 MB, whatever the corpus.  Vectors of texts are products with that matrix,
row by row.

Defined cases: null texts and texts without tokens have zero vectors (and similarity 0 by
``dense_cosine``); a corpus with fewer texts or tokens than the rank has zero vectors beyond
its own rank; repeated texts count each; an empty corpus has only zero vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .factuality import dense_cosine
from ..functions.barrier import staged
from ..functions.text import col_, rouge_tokens

BUCKETS = 1 << 13
RANK = 16
EXTRA = 8
PASSES = 4
SEED = 11
#: Rows of the product that leave a task together.
BLOCK = 512


def token_buckets(text, buckets: int = BUCKETS) -> Column:
    """Hash bucket of every ROUGE token of a text."""
    return F.transform(rouge_tokens(F.coalesce(col_(text), F.lit(""))),
                       lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _entries(texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the unit tf-idf rows of a batch of bucket arrays."""
    rows, cols, vals = [], [], []
    for i, b in enumerate(texts):
        col, n = np.unique(np.asarray(b, np.int64), return_counts=True)
        x = n * idf[col]
        norm = np.sqrt((x * x).sum())
        if norm > 0:
            rows.append(np.full(len(col), i))
            cols.append(col)
            vals.append(x / norm)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def _times(row, col, val, n: int, matrix: np.ndarray) -> np.ndarray:
    """The sparse batch times a dense matrix."""
    return np.stack([np.bincount(row, val * m[col], minlength=n) for m in matrix.T], 1)


def gram_product(rows: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'(A M) for the rows of (buckets) and a matrix of BUCKETS rows."""
    width = matrix.shape[1]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(matrix)
        for batch in batches:
            row, col, val = _entries(batch["b"], idf)
            y = _times(row, col, val, len(batch), matrix)
            total += _times(col, row, val, len(matrix), y)
        yield pd.DataFrame({"block": range(0, len(matrix), BLOCK),
                            "sums": [total[i:i + BLOCK].ravel() for i in range(0, len(matrix), BLOCK)]})

    def add(blocks: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [blocks["block"].iat[0]], "sums": [np.sum(np.stack(blocks["sums"]), 0)]})

    kind = "block int, sums array<double>"
    found = rows.mapInPandas(part, kind).groupBy("block").applyInPandas(add, kind).collect()
    out = np.zeros_like(matrix)
    for block, sums in found:
        out[block:block + BLOCK] = np.reshape(sums, (-1, width))
    return out


@dataclass(frozen=True)
class Space:
    """Leading right singular vectors (a column each), singular values, idf of the buckets."""

    vectors: np.ndarray
    values: np.ndarray
    idf: np.ndarray

    def embed(self, text) -> Column:
        """The vector of a text: its tf-idf row times the singular vectors."""
        vectors, idf = self.vectors, self.idf

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def place(buckets: pd.Series) -> pd.Series:
            row, col, val = _entries(buckets, idf)
            return pd.Series(list(_times(row, col, val, len(buckets), vectors)))

        return place(token_buckets(text, len(idf)))


def fit(docs: DataFrame, text: str, rank: int = RANK, buckets: int = BUCKETS, passes: int = PASSES,
        seed: int = SEED) -> Space:
    """The latent space of a table of texts."""
    rows = staged(docs.select(token_buckets(text, buckets).alias("b")).where("size(b) > 0"), "latent-rows")
    n = rows.count()
    held = rows.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").count().collect()
    idf = np.zeros(buckets)
    for b, df in held:       # at most one row a bucket
        idf[b] = np.log((1 + n) / (1 + df)) + 1
    width = min(rank + EXTRA, buckets)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))[0]
    if not n:
        return Space(np.zeros((buckets, rank)), np.zeros(rank), idf)
    for _ in range(passes):
        v = np.linalg.qr(gram_product(rows, idf, v))[0]
    values, turn = np.linalg.eigh(v.T @ gram_product(rows, idf, v))
    first = np.argsort(-values)[:rank]
    values = np.sqrt(np.maximum(values[first], 0))
    vectors = (v @ turn[:, first]) * (values > 1e-9)
    # the sign of a singular vector is free: its largest entry is positive
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Space(vectors * np.where(signs == 0, 1, signs), values, idf)


def latent_cosine(pairs: DataFrame, a_text: str, b_text: str, space: Space, out: str = "latent_cosine") -> DataFrame:
    """``pairs`` with the cosine of the vectors of two texts."""
    kept = [c for c in pairs.columns if c != out]
    d = pairs.select(*kept, space.embed(a_text).alias("_va"), space.embed(b_text).alias("_vb"))
    return d.withColumn(out, dense_cosine("_va", "_vb")).drop("_va", "_vb")
