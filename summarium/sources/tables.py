"""Driver tables and the derived inputs every operator family reads.

The reference consumes a news CSV plus model outputs.  Here the article table,
the candidate summaries and the training-step log are derived by Spark from
the driver's ``documents`` table (the seeded view of FIXTURES.md section 3), so
each query's work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.barrier import materialize
from ..functions.text import words

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Stored bytes up to which a text table is dealt over all cores.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core rows of a small, CPU-heavy text table.

    A file of one row group is read by one task however it is split, and the
    per-row text work (tokenising, scoring) then runs on one core.  A table of
    at most ``SPREAD_BYTES`` (the planner's size of the scan) is
    hash-partitioned on ``key`` (deterministic on retry, no sort); a larger one
    is never shuffled, whatever the number of cores.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


# ---------------------------------------------------------------------------
# Fixed values of the seeded view (FIXTURES.md section 3).
SEED_EPOCH = "2023-01-01"
SEED_DAY_CYCLE = 500
SEED_SUMMARY_TOKENS = 55
SEED_DATE_SHIFT_DAYS = 400
DATE_TEXT_FORMAT = "MMMM d, yyyy"


def as_table(df: DataFrame) -> DataFrame:
    """End a derived view so it behaves like a stored table: later filters
    and projections read its columns as values (see ``functions.barrier``;
    without it the corpus filters re-ran the tokenizer 20x per row)."""
    return materialize(df)


def _seed_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source"), "doc_id")
    d = F.date_add(F.lit(SEED_EPOCH).cast("date"),
                   (F.col("doc_id") % SEED_DAY_CYCLE).cast("int"))
    return docs.withColumn("tk", words("text")).withColumn("pub_date", d)


def articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Seeded article view: (article_id, lang, category, pub_date, date,
    headline, article, summary), or those of its columns that are named.
    Every row has an article and a summary.  The view ends in a barrier that
    column pruning does not cross, so callers name what they need."""
    base = _seed_frame(spark, sf_dir)
    d = F.col("pub_date")
    sum_date = F.when(F.col("doc_id") % 3 == 0,
                      F.date_add(d, SEED_DATE_SHIFT_DAYS)).otherwise(d)
    article = F.concat(
        F.array_join("tk", " "),
        F.lit(" The Chief Minister announced Rs "),
        (F.col("doc_id") % 90 + 1).cast("string"),
        F.lit(" crore on "), F.date_format(d, DATE_TEXT_FORMAT), F.lit("."))
    summary = F.concat(
        F.array_join(F.slice("tk", 1, SEED_SUMMARY_TOKENS), " "),
        F.when(F.col("doc_id") % 2 == 0, F.lit(" Rs crore"))
         .otherwise(F.lit(" Rs million")),
        F.lit(" on "), F.date_format(sum_date, DATE_TEXT_FORMAT), F.lit("."))
    view = base.select(
        F.col("doc_id").alias("article_id"),
        "lang",
        F.col("source").alias("category"),
        "pub_date",
        F.date_format(d, "yyyy-MM-dd").alias("date"),
        F.array_join(F.slice("tk", 1, 6), " ").alias("headline"),
        article.alias("article"),
        summary.alias("summary"),
    )
    return as_table(view.select(*columns) if columns else view)


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded view with the gaps a raw news dump has: category missing
    for one source, summary missing for every 17th article."""
    a = articles(spark, sf_dir)
    return as_table(a.select(
        "article_id", "headline", "article",
        F.when(F.col("article_id") % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("summary")).alias("summary"),
        F.when(F.col("category") == "src3", F.lit(None).cast("string"))
         .otherwise(F.col("category")).alias("category"),
        "date", "lang"))


# ---------------------------------------------------------------------------
# Candidate systems (stand-in for neural generation, FIXTURES.md section 3):
# name, model id, first token offset (1-based), span length in words.
SYSTEMS = [
    ("Lead-40", "extractive/lead-40", 1, 40),
    ("Lead-150", "extractive/lead-150", 1, 150),
    ("Mid-60", "extractive/mid-60", 20, 60),
    ("Long-LED", "extractive/led-long-120", 1, 120),
    ("Mini-T5", "extractive/t5-mini-80", 30, 80),
]
EVALUATION_DATE = "2025-01-01"   # of the stand-in run
FAILING_SYSTEM = "Mini-T5"
FAILING_MODULUS = 13


def systems(spark: SparkSession) -> DataFrame:
    """System registry: a fixed 5-row dimension (always broadcast)."""
    return spark.createDataFrame(
        SYSTEMS, "system string, model_id string, off int, len int")
