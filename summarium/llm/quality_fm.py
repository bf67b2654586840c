"""Quality classifier: a factorisation machine.

Features of a document are its hashed words (term frequencies of unit length), one-hot
bins of structure statistics (case, symbols, digits, lines, repetition, lengths) and
bins of numeric metadata columns.  The machine adds to a linear score all pairwise
interactions through ``FACTORS``-dimensional factors; with the sum-of-squares identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

a document is scored in time linear in its features.

Fitting reads a bounded sample of labelled rows (``TRAIN_ROWS``) and runs as Spark jobs
(``pyspark.ml`` factorisation machine).  Scoring reads every whole text once, row-local,
without a shuffle; the fitted weights (half a megabyte) travel with the function.

Defined cases: null text and empty text score by their structure bins; missing metadata
has a bin of its own; labels other than 0 and 1, labels of ids that bear both, and null
ids train nothing; without a label of both classes the score is the share of label 1
(0.5 without labels); repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WORD_BUCKETS = 1 << 12
FACTORS = 8
#: Most labelled rows that a fit reads; more are thinned out by a hash of the id.
TRAIN_ROWS = 20_000
ITERATIONS = 60
SEED = 7
BINS = 16
#: Structure statistics, each in ``BINS`` bins.
STATS = ("words", "chars", "lines", "word_length", "line_words", "upper", "digit", "symbol",
         "bar", "bang", "stop", "comma", "wide", "distinct", "top_word", "line_repeat",
         "last_line_end", "token_symbol")
THRESHOLD = 0.3


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(math.log2(x + 1)))


def _share_bin(x: float) -> int:
    """Bins on a square-root scale: fine near 0."""
    return min(BINS - 1, int(BINS * math.sqrt(min(1.0, max(0.0, x)))))


_BUCKET: dict[str, int] = {}
_CACHE = 120_000


def _bucket(word: str) -> int:
    b = _BUCKET.get(word)
    if b is None:
        if len(_BUCKET) >= _CACHE:
            _BUCKET.clear()
        b = _BUCKET[word] = zlib.crc32(word.encode()) % WORD_BUCKETS
    return b


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[]^_`{}~\\"]] = True


def structure_bins(text: str, words: list[str], counts: Counter) -> list[int]:
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n_bytes = max(1, int(raw.sum()))
    lines = text.split("\n")
    n_words, n_lines = len(words), len(lines)
    full = [x for x in lines if x]
    some = max(1, n_words)
    return [
        _log_bin(n_words), _log_bin(len(text)), _log_bin(n_lines),
        min(BINS - 1, int(len(text) / some)), _log_bin(n_words / n_lines),
        _share_bin(raw[65:91].sum() / n_bytes), _share_bin(raw[48:58].sum() / n_bytes),
        _share_bin(raw[_SYMBOLS].sum() / n_bytes), _share_bin(raw[124] / n_bytes),
        _share_bin(raw[33] / n_bytes), _share_bin(raw[46] / n_bytes), _share_bin(raw[44] / n_bytes),
        _share_bin(raw[128:].sum() / n_bytes), _share_bin(len(counts) / some),
        _share_bin(max(counts.values(), default=0) / some),
        _share_bin(1 - len(set(full)) / max(1, len(full))),
        (ord(text.rstrip()[-1]) % BINS) if text.strip() else 0,
        _share_bin(sum(c for w, c in counts.items() if not w[-1].isalnum()) / some),
    ]


def dimension(metadata: tuple[str, ...]) -> int:
    return WORD_BUCKETS + BINS * len(STATS) + (BINS + 1) * len(metadata)


def featurise(text: str | None, metadata: tuple) -> tuple[list[int], list[float]]:
    """(ascending feature numbers, values) of one document."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    by: dict[int, float] = {}
    for w, c in counts.items():
        b = _bucket(w)
        by[b] = by.get(b, 0.0) + c
    norm = math.sqrt(sum(v * v for v in by.values())) or 1.0
    idx = sorted(by)
    val = [by[i] / norm for i in idx]
    at, one = WORD_BUCKETS, 1.0 / math.sqrt(len(STATS))
    for b in structure_bins(text, words, counts):
        idx.append(at + b)
        val.append(one)
        at += BINS
    for m in metadata:
        missing = m is None or not np.isfinite(m)
        idx.append(at + (BINS if missing else _log_bin(max(0.0, float(m)))))
        val.append(one)
        at += BINS + 1
    return idx, val


def _featurise_batch(text: pd.Series, *metadata: pd.Series) -> pd.DataFrame:
    rows = [featurise(t, m) for t, *m in zip(text, *metadata)]
    return pd.DataFrame(rows, columns=["idx", "val"])


def features(text: Column, metadata: list[Column]) -> Column:
    return F.pandas_udf(_featurise_batch, "idx array<int>, val array<double>")(
        text, *[m.cast("double") for m in metadata])


@dataclass(frozen=True)
class Machine:
    """Fitted weights: score = sigmoid(bias + linear + pairwise)."""

    metadata: tuple[str, ...]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """Scores of featurised documents by the sum-of-squares identity."""
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        idx = np.concatenate([np.asarray(i, np.int64) for i, _ in rows])
        val = np.concatenate([np.asarray(v, np.float64) for _, v in rows])
        scaled = self.factors[idx] * val[:, None]
        sums = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(scaled * scaled, starts)
        z = (self.bias + np.add.reduceat(self.linear[idx] * val, starts)
             + 0.5 * (sums * sums - squares).sum(1))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))

    def column(self, text: Column, metadata: list[Column]) -> Column:
        def batch(texts: pd.Series, *meta: pd.Series) -> pd.Series:
            rows = zip(texts, *meta)
            out, part = [], []
            for t, *m in rows:
                part.append(featurise(t, tuple(m)))
                if len(part) == 256:
                    out.append(self.score(part))
                    part = []
            out.append(self.score(part))
            return pd.Series(np.concatenate(out))

        def run(batches):
            for columns in batches:
                yield batch(*columns) if isinstance(columns, tuple) else batch(columns)
            # a worker lives on after its task: give back what it held
            _BUCKET.clear()
            pa.default_memory_pool().release_unused()
        return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(
            text, *[m.cast("double") for m in metadata])


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Rows that never train: crc32 of the id as text divides by ``folds``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_ids(labels: DataFrame, key: str = "doc_id", label: str = "quality",
                 most: int = TRAIN_ROWS) -> DataFrame:
    """(key, label) outside the held-out fold: at most about ``most`` rows, chosen by a
    hash of the id so that no sort or single task is needed."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
                   .groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("other"))
                   .where(F.col("label") == F.col("other")).select(key, "label"))
    known = staged(known, "labels")
    n = known.count()
    if n > most:
        share = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1 << 20))
        known = known.where(share < int((1 << 20) * most / n))
    return known


def _given(docs: DataFrame, metadata: tuple[str, ...]) -> Column:
    """Struct of the metadata columns; null where the table has none of that name."""
    return F.struct(F.lit(0).alias("none"), *[
        (F.col(m) if m in docs.columns else F.lit(None)).cast("double").alias(m) for m in metadata])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", metadata: tuple[str, ...] = ("n_chars",),
        most: int = TRAIN_ROWS) -> Machine:
    """Fit on labelled documents outside the held-out fold."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.linalg import Vectors, VectorUDT

    size = dimension(metadata)
    ids = training_ids(labels, key, label, most)
    # at most ``most`` ids of 16 bytes: the bound is the parameter
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), _given(docs, metadata).alias("m"))
    chosen = own.join(F.broadcast(ids.withColumnRenamed(key, "id")), "id").select(
        "label", features(F.col("t"), [F.col("m")[m] for m in metadata]).alias("f"))
    vector = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())
    rows = staged(chosen.select(F.col("label").cast("double").alias("label"), "f.idx", "f.val"),
                  "quality-features")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or good in (0, n):
        p = min(0.999, max(0.001, good / n)) if n else 0.5
        return Machine(metadata, math.log(p / (1 - p)), np.zeros(size), np.zeros((size, 1)))
    parts = max(2, min(rows.sparkSession.sparkContext.defaultParallelism, int(n) // 2000))
    train = rows.repartition(parts).select("label", vector("idx", "val").alias("features")).persist()
    try:
        model = FMClassifier(factorSize=FACTORS, maxIter=ITERATIONS, stepSize=0.1, regParam=1e-4,
                             initStd=0.05, seed=SEED, solver="adamW").fit(train)
    finally:
        train.unpersist()
    return Machine(metadata, float(model.intercept), model.linear.toArray(),
                   model.factors.toArray())


def score_documents(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """The score column of a table."""
    given = _given(docs, machine.metadata)
    return machine.column(F.col(text), [given[m] for m in machine.metadata])
