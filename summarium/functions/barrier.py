"""Evaluate derived columns once, whatever the optimizer would rewrite.

Catalyst may substitute a derived column by its defining expression: when it
collapses projections (a column read once, even inside a lambda, is inlined
and then re-evaluated per element), and when it pushes a filter below a
projection (each predicate re-runs the derivation).  Neither is costed.  A
one-row ``inline`` of a struct is a generator: projections do not collapse
through it and predicates on its outputs cannot cross it, so the columns are
computed once per row and read as values above it.  It costs one struct per
row and no shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back: computed once
    for several readers, safe from lost executors, and of a size the planner knows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
