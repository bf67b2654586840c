"""Leaderboard analytics over per-system aggregate rows.

Inputs hold one row per system, so the unpartitioned windows used for the
positional rank run on a table whose size is the number of systems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Leaderboard column names and the aggregate fields they show.
LEADERBOARD_FIELDS = [
    ("Model", "model_name"),
    ("ROUGE-1", "rouge1_mean"),
    ("ROUGE-2", "rouge2_mean"),
    ("ROUGE-L", "rougeL_mean"),
    ("ROUGE-1 Std", "rouge1_std"),
    ("ROUGE-2 Std", "rouge2_std"),
    ("ROUGE-L Std", "rougeL_std"),
    ("Total Samples", "total_samples"),
    ("Successful", "successful_samples"),
    ("Failed", "failed_samples"),
    ("Success Rate", "success_rate"),
]
SUMMARY_COLUMNS = ["Rank", "Model", "ROUGE-1", "ROUGE-2", "ROUGE-L",
                   "Success Rate", "Time Hours"]
MEDALS = {1: "GOLD", 2: "SILVER", 3: "BRONZE"}
SELECTED_MARK = "LED"


def project(aggregates: DataFrame) -> DataFrame:
    """L1 + L2: rename the score fields, seconds -> hours (2 dp)."""
    cols = [F.col(src).alias(dst) for dst, src in LEADERBOARD_FIELDS]
    cols.append(F.round(F.col("evaluation_time_seconds") / 3600, 2).alias("Time Hours"))
    return aggregates.select(*cols)


def rank(board: DataFrame, metric: str = "ROUGE-2") -> DataFrame:
    """L3 + L4: order by metric desc (NaN treated as missing, last), rank
    1..n with ties broken by model name."""
    m = F.col(f"`{metric}`")
    clean = F.when(F.isnan(m), F.lit(None)).otherwise(m)
    w = Window.orderBy(clean.desc_nulls_last(), F.col("Model").asc())
    ranked = board.withColumn("Rank", F.row_number().over(w))
    return ranked.select("Rank", *[c for c in board.columns])


def with_medal(ranked: DataFrame) -> DataFrame:
    """L5."""
    medal = F.lit("")
    for pos in sorted(MEDALS, reverse=True):
        medal = F.when(F.col("Rank") == pos, F.lit(MEDALS[pos])).otherwise(medal)
    return ranked.withColumn("Medal", medal)


def with_selected(board: DataFrame, mark: str = SELECTED_MARK) -> DataFrame:
    """Selected flag, null-safe."""
    return board.withColumn("Selected", F.coalesce(F.col("Model").contains(mark), F.lit(False)))


def best(ranked: DataFrame) -> DataFrame:
    """Best overall row (rank 1) plus the best model per metric."""
    def best_of(metric):
        # highest metric first, ties -> alphabetically first model
        return F.min_by("Model", F.struct((-F.col(f"`{metric}`")).alias("m"), F.col("Model")))
    return ranked.agg(
        F.min_by("Model", "Rank").alias("best_model"),
        F.min_by(F.col("`ROUGE-2`"), "Rank").alias("best_rouge2"),
        F.min_by(F.col("`ROUGE-2 Std`"), "Rank").alias("best_rouge2_std"),
        best_of("ROUGE-1").alias("best_rouge1_model"),
        best_of("ROUGE-2").alias("best_rouge2_model"),
        best_of("ROUGE-L").alias("best_rougeL_model"),
    )


def totals(board: DataFrame) -> DataFrame:
    """L8."""
    return board.agg(
        F.count(F.lit(1)).alias("total_models"),
        F.count_if(F.col("`Success Rate`") == 100.0).alias("full_success_models"),
        F.sum("Successful").alias("total_successful"),
        F.sum("Failed").alias("total_failed"),
        F.round(F.avg(F.col("`ROUGE-2`")), 2).alias("avg_rouge2"),
        F.round(F.sum(F.col("`Time Hours`")), 2).alias("total_hours"))


def summary(ranked: DataFrame) -> DataFrame:
    """L9."""
    return ranked.select(*[F.col(f"`{c}`") for c in SUMMARY_COLUMNS])


def domain_shift(board: DataFrame, indomain: DataFrame, metric: str = "ROUGE-2") -> DataFrame:
    """Relative change against a published in-domain score.
    ``indomain(system, score)`` is a small dimension."""
    j = board.join(indomain, board["Model"] == indomain["system"], "inner")
    m = F.col(f"`{metric}`")
    return j.select(
        F.col("Model"), F.col("score").alias("indomain"), m.alias("outdomain"),
        F.round(m - F.col("score"), 2).alias("delta"),
        F.round(F.when(F.col("score") != 0, (m - F.col("score")) / F.col("score") * 100), 1)
         .alias("relative_change_pct"))


def speed_extremes(aggregates: DataFrame) -> DataFrame:
    """Fastest / slowest system by seconds per sample, and the mean."""
    key_fast = F.struct(F.col("time_per_sample"), F.col("model_name"))
    key_slow = F.struct((-F.col("time_per_sample")), F.col("model_name"))
    return aggregates.agg(
        F.min_by("model_name", key_fast).alias("fastest_model"),
        F.min("time_per_sample").alias("fastest_seconds"),
        F.min_by("model_name", key_slow).alias("slowest_model"),
        F.max("time_per_sample").alias("slowest_seconds"),
        F.round(F.avg("time_per_sample"), 2).alias("avg_seconds"))


def phase_compare(long_metrics: DataFrame, baseline: str, proposed: str) -> DataFrame:
    """``(metric, phase, value)`` -> one row per metric with both phases
    side by side and the difference in points."""
    p = (long_metrics.filter(F.col("phase").isin(baseline, proposed))
                     .groupBy("metric").pivot("phase", [baseline, proposed])
                     .agg(F.first("value")))
    return p.select("metric", F.col(f"`{baseline}`").alias("baseline"),
                    F.col(f"`{proposed}`").alias("proposed"),
                    F.round(F.col(f"`{proposed}`") - F.col(f"`{baseline}`"), 2).alias("delta"))


def size_pairs(board: DataFrame, sizes: DataFrame, metric: str = "ROUGE-2") -> DataFrame:
    """Each model against the next larger model of its family.

    ``sizes(Model, family, size)`` is a small dimension.  ``lead`` over the
    family ordered by size pairs neighbours only (no self-join, no all-pairs).
    """
    b = board.join(sizes, "Model")
    w = Window.partitionBy("family").orderBy("size", "Model")
    m = F.col(f"`{metric}`")
    nxt = (b.withColumn("large_model", F.lead("Model").over(w))
            .withColumn("large_score", F.lead(m).over(w)))
    return nxt.filter(F.col("large_model").isNotNull()).select(
        "family", F.col("Model").alias("small_model"), "large_model",
        m.alias("small_score"), "large_score",
        F.round(F.col("large_score") - m, 2).alias("delta"))
