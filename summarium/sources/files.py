"""File sources and sinks (S1-S8): article CSV, per-system score JSON,
CSV/JSON/parquet sinks, partitioned append and write-if-absent.

Scratch output goes under the session's checkpoint folder, which on a cluster
is the shared location named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import normalise_headers
from ..session import ensure_checkpoint_dir

# Column names of the raw article dump (headers may carry stray whitespace).
RAW_ARTICLE_COLUMNS = ["article_text", "human_summary", "headline",
                       "news_category", "published_date"]
RAW_ARTICLE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_ARTICLE_COLUMNS])

AGGREGATE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("model_name", "model_id", "evaluation_date")]
    + [T.StructField(c, T.LongType()) for c in ("total_samples", "successful_samples", "failed_samples")]
    + [T.StructField(c, T.DoubleType()) for c in (
        "success_rate", "rouge1_mean", "rouge2_mean", "rougeL_mean", "rouge1_std", "rouge2_std",
        "rougeL_std", "evaluation_time_seconds", "time_per_sample", "avg_input_length",
        "avg_padded_length", "padding_overhead_percent")])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


# S1 / P2 --------------------------------------------------------------------
def read_articles_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Multi-line, quoted CSV of articles.  With no schema, every column is a
    string named from the header, normalised (strip, drop newlines).
    multiLine CSV is not splittable: convert to parquet right after reading."""
    r = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("quote", '"'))
    if schema is not None:
        return r.schema(schema).csv(path)
    return normalise_headers(r.option("inferSchema", False).csv(path))


# S2 / S3 / S4 -----------------------------------------------------------------
def read_score_folders(spark: SparkSession, base: str, file_glob: str = "aggregate_scores.json") -> DataFrame:
    """One aggregate-score JSON per system folder; ``folder`` from the path.
    Only files matching ``file_glob`` under ``base/<folder>/`` are read."""
    df = (spark.read.schema(AGGREGATE_SCHEMA).option("multiLine", True)
               .json(f"{base.rstrip('/')}/*/{file_glob}")
               .select("*", F.col("_metadata.file_path").alias("_path")))
    folder = F.regexp_extract("_path", r"/([^/]+)/[^/]+$", 1)
    folder = F.regexp_replace(folder, "^[^=]+=", "")     # partition-style folders
    return df.withColumn("folder", folder).drop("_path")


def missing_sources(expected: DataFrame, found: DataFrame, expected_col: str, found_col: str) -> DataFrame:
    """Expected sources with no data (NOT FOUND report): a left anti join."""
    f = found.select(F.col(found_col).alias(expected_col)).distinct()
    return expected.join(f, expected_col, "left_anti")


# S5-S8 ----------------------------------------------------------------------
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", True) \
        .option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def append_partitioned(df: DataFrame, path: str, by: str = "system", part: str | None = None) -> None:
    """Append rows to a parquet table partitioned by ``by``.

    ``part`` names what is appended (a run, a batch): it becomes the first partition
    column, and writing the same part again replaces it, so a retried append changes
    nothing.  Without it every call adds its rows."""
    if part is None:
        df.write.mode("append").partitionBy(by).parquet(path)
    else:
        df.write.mode("overwrite").partitionBy(by).parquet(f"{path.rstrip('/')}/part={part}")


def write_if_absent(df: DataFrame, path: str) -> None:
    """Write once; later calls leave the existing data untouched."""
    df.write.mode("ignore").parquet(path)
