"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from ..sources.tables import read_table

__all__ = ["ready", "read_table", "staged", "text_or_empty", "row_key", "unit_hash"]


def ready(spark: SparkSession) -> SparkSession:
    """Checkpoint folder known and the package importable by the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder, read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs a re-read and not a recomputation.  The written size is what the
    planner sees, so joins with a staged table are broadcast exactly when the
    table is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(text: str = "text") -> Column:
    """64-bit hash of the text (null apart from empty): with the id it names a
    row by content, so it is the same on every retry."""
    return F.xxhash64(F.col(text).isNull(), text_or_empty(text))


def unit_hash(*parts: Column) -> Column:
    """Uniform double in [0, 1): 52 bits of the MD5 of the colon-joined parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
