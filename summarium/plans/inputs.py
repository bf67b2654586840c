"""Derived inputs shared by the registered queries (Spark side).

Each builder reads the driver tables under ``sf_dir`` and derives the
tables the reference works on; nothing here is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, leaderboard
from ..sources import tables as T


def articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return T.articles(spark, sf_dir, *columns)


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw_articles(spark, sf_dir)


def predictions(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Candidates of every system for all articles, or for the ids of ``only``."""
    a = articles(spark, sf_dir, "article_id", "article", "summary")
    if only is not None:
        a = a.join(only.select("article_id"), "article_id", "left_semi")
    return predictions_of(spark, a)


def predictions_of(spark: SparkSession, a: DataFrame) -> DataFrame:
    """Candidates of every system for articles (article_id, article, summary)."""
    return evaluate.build_predictions(a, T.systems(spark), T.FAILING_SYSTEM,
                                      T.FAILING_MODULUS)


# The oracle-checked queries score unstemmed tokens (SQL has no stemmer);
# the library default and the rows-only stemmed queries stem.
def scores(spark: SparkSession, sf_dir: str, use_stemmer: bool = False) -> DataFrame:
    return evaluate.score_predictions(predictions(spark, sf_dir), use_stemmer=use_stemmer)


def aggregates(spark: SparkSession, sf_dir: str, use_stemmer: bool = False) -> DataFrame:
    return evaluate.system_aggregates(scores(spark, sf_dir, use_stemmer),
                                      evaluation_date=T.EVALUATION_DATE)


def board(spark: SparkSession, sf_dir: str, use_stemmer: bool = False) -> DataFrame:
    return leaderboard.project(aggregates(spark, sf_dir, use_stemmer))


def ranked(spark: SparkSession, sf_dir: str, use_stemmer: bool = False) -> DataFrame:
    return leaderboard.rank(board(spark, sf_dir, use_stemmer))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, source, summary) over the seeded view."""
    return articles(spark, sf_dir, "article_id", "article", "summary").select(
        F.col("article_id").alias("pair_id"), F.col("article").alias("source"), "summary")


def system_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, pair_id, source, summary) + source features: candidates
    against their source, with the source-side factuality inputs computed
    once per article before the fan-out to systems."""
    from ..operators.factuality import SOURCE_FEATURES, with_source_features
    a = articles(spark, sf_dir, "article_id", "article", "summary")
    a = with_source_features(a, "article")
    p = evaluate.build_predictions(a, T.systems(spark), T.FAILING_SYSTEM, T.FAILING_MODULUS,
                                   carry=SOURCE_FEATURES)
    return p.filter(F.col("status") == "ok").select(
        "system", F.col("article_id").alias("pair_id"), "source",
        F.col("generated").alias("summary"), *SOURCE_FEATURES)


STAGE_BY_MOD3 = ["warmup", "factuality", "refinement"]


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-step log stand-in: one step per article, stage by id mod 3,
    batch index id div 3, epoch 1, cross-entropy from the id; the step's
    source and generated texts are the seeded article and summary."""
    a = articles(spark, sf_dir, "article_id", "article", "summary")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGE_BY_MOD3]),
                         (F.col("article_id") % 3 + 1).cast("int"))
    return a.select(stage.alias("stage"), F.lit(1).cast("bigint").alias("epoch"),
                    F.floor(F.col("article_id") / 3).cast("bigint").alias("batch_idx"),
                    (F.lit(0.5) + (F.col("article_id") % 11) / F.lit(10.0)).alias("ce"),
                    F.col("article").alias("source"), F.col("summary").alias("generated"))
