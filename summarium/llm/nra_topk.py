"""Exact top-k by inner product with the no-random-access algorithm.

Candidates are dealt into blocks of bounded size; a block keeps, for every component, its
values in sorted order.  The lists are not read entry by entry: a batch of queries scores the
block densely, and at depths that double the frontier of every list, from the end its weight
favours, gives the bounds as matrix products over all rows.  A row seen in some lists has a lower
bound (what was read plus the worst the unread lists can still give it) and an upper bound
(what was read plus the frontier of the unread lists).  Reading stops when no row outside the
best k lower bounds can reach the k-th of them and only few rows are left, which then get
their final scores (components are integers below 2^53, so sums of doubles are exact).  The blocks' winners are merged per query.

Scale: blocks of queries meet blocks of candidates, so a task holds ``BLOCK_ROWS``
candidates and ``QUERY_ROWS`` queries whatever the input; nothing is broadcast.  The queries
are the stated set (ids divisible by 50), against all rows.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part,
as query or candidate; shorter vectors count as padded with zeros; a row never answers its own
query, other rows of its id do; every row of a query id is a query of its own, with its own
answers; rows with the same id are candidates each; rows without an id are candidates that
answer with a null id, after others of their score; ties go to the smaller id; fewer candidates than k give fewer answers; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Queries that read the lists of a block together.
BATCH = 256
#: The first depth is this part of a list; then it doubles.
FIRST_DEPTH = 8
#: Rows left over, as a multiple of k, at which reading ends and final scores are taken.
FEW = 40


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
              scale: int = 256) -> DataFrame:
    """(row, id, noid, v): components as floor(scale * x); unusable vectors left out.
    ``row`` numbers the rows, ``noid`` marks those without an id (then 0)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return (vectors.where(F.col(vector).isNotNull() & ~bad)
                   .select(F.monotonically_increasing_id().alias("row"),
                           F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("id"),
                           F.col(key).isNull().cast("int").alias("noid"),
                           F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
                            .alias("v")))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class SortedLists:
    """The rows of a block and, for every component, its values in sorted order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, number: np.ndarray | None = None,
                 noid: np.ndarray | None = None):
        self.ids, self.rows = ids, rows.astype(np.float64)
        self.number = ids if number is None else number
        self.noid = np.zeros(len(ids), np.int64) if noid is None else noid
        self.sorted = np.sort(self.rows, axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x rows) after reading ``depth`` entries of
        every list, and the ties of the last: positive weights read the list from its
        large end, negative ones from its small end.  An unread entry lies between the
        far end of its list and the frontier."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        n = len(self.ids)
        high, low = self.sorted[n - depth], self.sorted[depth - 1]  # the frontiers
        lower = (up @ np.where(self.rows >= high, self.rows, self.sorted[0]).T
                 + down @ np.where(self.rows <= low, self.rows, self.sorted[-1]).T)
        upper = up @ np.maximum(self.rows, high).T + down @ np.minimum(self.rows, low).T
        # every row, read or not: maximum(x, frontier) is x where it was read
        return lower, upper

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """For each query the best k (score, noid, id) of the block, without the query's
        own row; by score, then by smaller id, rows without an id last."""
        n = len(self.ids)
        out: list[list[tuple[int, int, int]]] = [[] for _ in queries]
        waiting = np.arange(len(queries))
        depth = max(1, n // FIRST_DEPTH)
        while len(waiting):
            lower, upper = self.bounds(queries[waiting].astype(np.float64), depth)
            barred = own[waiting][:, None] == self.number[None, :]
            lower[barred], upper[barred] = -np.inf, -np.inf
            kth = np.partition(lower, max(0, n - k), axis=1)[:, max(0, n - k)]
            hopeful = (upper >= kth[:, None]) & ~barred
            done = (hopeful.sum(1) <= FEW * k) | (depth == n)
            for j in np.flatnonzero(done):
                rows = np.flatnonzero(hopeful[j])
                out[waiting[j]] = self._resolve(rows, queries[waiting[j]], k)
            waiting = waiting[~done]
            depth = min(n, 2 * depth)
        return out

    def _resolve(self, rows: np.ndarray, query: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        final = self.rows[rows] @ query.astype(np.float64)
        best = np.lexsort((self.ids[rows], self.noid[rows], -final))[:k]
        return [(int(final[i]), int(self.noid[rows[i]]), int(self.ids[rows[i]])) for i in best]


def _search(k: int):
    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            width = max(queries["v"].map(len).max(), candidates["v"].map(len).max())
            block = SortedLists(candidates["id"].to_numpy(np.int64), _matrix(candidates["v"], width),
                                candidates["row"].to_numpy(np.int64), candidates["noid"].to_numpy(np.int64))
            own, vectors = queries["row"].to_numpy(np.int64), _matrix(queries["v"], width)
            ids = queries["id"].to_numpy(np.int64)
            for at in range(0, len(own), BATCH):
                part = own[at:at + BATCH]
                for q, name, best in zip(part, ids[at:at + BATCH], block.top(vectors[at:at + BATCH], part, k)):
                    out += [(int(q), int(name), i, none, s) for s, none, i in best]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "noid", "score"], dtype="int64")
    return meet


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    # staged, so that a row's number is the same for queries and candidates and on a retry
    rows = staged(quantised(vectors, key, vector), "quantised")
    n = vectors.count()
    n_blocks = max(1, -(-n // BLOCK_ROWS))
    n_parts = max(1, -(-(n // every + 1) // QUERY_ROWS))
    # salted by the vector: rows of one id are dealt over the blocks
    candidates = (rows.withColumn("block", F.pmod(F.xxhash64("id", "v", "row"), F.lit(n_blocks)).cast("int"))
                      .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))))
    queries = (rows.where((F.col("noid") == 0) & (F.col("id") % every == 0))
                   .withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id", "v", "row"), F.lit(n_parts)).cast("int"))
                   .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    found = (queries.groupBy("part", "block").cogroup(candidates.groupBy("part", "block"))
                    .applyInPandas(_search(k), "row long, query_id long, vec_id long, noid long, score long"))
    best = W.partitionBy("row").orderBy(F.desc("score"), "noid", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int"),
                         F.when(F.col("noid") == 0, F.col("vec_id")).alias("vec_id"), "score"))
