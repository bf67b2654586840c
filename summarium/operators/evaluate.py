"""Evaluation: prediction table, per-pair scores, per-system aggregates and
resume (A1-A9).  ``system`` is a column and a grouping key -- there is no loop
over systems and no driver-side collection of per-row results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rouge import rouge_scores
from .shaping import (extractive_candidates, is_long_context, is_t5_family,
                      padded_length, token_length, with_task_prefix)
from ..functions.text import preview

ERROR_CHARS = 100
MAX_ERRORS_PER_SYSTEM = 5


def build_predictions(articles: DataFrame, systems: DataFrame,
                      failing_system: str | None = None,
                      failing_modulus: int = 13, carry: tuple = (),
                      candidates: DataFrame | None = None) -> DataFrame:
    """(system, article_id) rows with the model input, reference, candidate,
    lengths, timing and status -- the table a generation job would write.

    A null/empty article or reference marks the row failed (the reference
    scored the string 'nan'; that is a documented fix).  ``carry`` names
    per-article columns computed before the fan-out to systems.  ``candidates`` are
    articles with (system, model_id, generated, source_words) of other systems, added to
    those of the registry.
    """
    cand = extractive_candidates(articles, systems, text="article")
    if candidates is not None:
        cand = cand.unionByName(candidates, allowMissingColumns=True)
    long_ctx = is_long_context(F.col("model_id"))
    model_input = with_task_prefix(F.col("article"), F.col("model_id"))
    # the prefix ends in a space, so it adds exactly one word to the article's
    input_words = F.col("source_words") + F.when(is_t5_family(F.col("model_id")), 1).otherwise(0)
    n_in = token_length(model_input, long_ctx, input_words)
    failed_gen = F.lit(False)
    if failing_system is not None:
        failed_gen = (F.col("system") == failing_system) & \
                     (F.col("article_id") % failing_modulus == 0)
    bad_input = F.col("article").isNull() | (F.col("article") == "") | \
        F.col("summary").isNull() | (F.col("summary") == "")
    status = F.when(bad_input | failed_gen, F.lit("failed")).otherwise(F.lit("ok"))
    error = (F.when(bad_input, F.lit("empty article or reference"))
              .when(failed_gen, F.concat(F.lit("generation error on article "),
                                         F.col("article_id").cast("string"),
                                         F.lit(": decoder produced no tokens")))
              .otherwise(F.lit(None).cast("string")))
    return cand.select(
        "system", "model_id", "article_id",
        F.col("article").alias("source"),
        model_input.alias("model_input"),
        F.col("summary").alias("reference"),
        F.when(status == "ok", F.col("generated")).alias("generated"),
        n_in.alias("input_length"),
        padded_length(n_in, long_ctx).alias("padded_length"),
        ((F.col("article_id") % 7) * 0.5).cast("double").alias("seconds"),
        status.alias("status"), error.alias("error"),
        F.lit("run-1").alias("run_id"), *carry)


def score_predictions(preds: DataFrame, use_stemmer: bool = True) -> DataFrame:
    """Per-pair result rows (M6): ids, preview, lengths, unrounded and
    4-dp scores.  Failed rows are kept with null scores."""
    ok = F.col("status") == "ok"
    scored = rouge_scores(preds.withColumn("generated", F.when(ok, F.col("generated"))),
                          "reference", "generated", use_stemmer=use_stemmer)
    return scored.select(
        "system", "model_id", "article_id", "status", "error", "run_id",
        preview("model_input").alias("article_preview"),
        "reference", "generated", "input_length", "padded_length", "seconds",
        "rouge1", "rouge2", "rougeL",
        *[F.round(m, 4).alias(f"{m}_r4") for m in ("rouge1", "rouge2", "rougeL")])


def _pct(x: Column, nd: int) -> Column:
    return F.round(x * 100, nd)


def system_aggregates(scores: DataFrame, run_id: str | None = None,
                      evaluation_date: str | None = None) -> DataFrame:
    """One row per system with the 18 aggregate-score fields (A1-A5).

    ``std`` is the population standard deviation (numpy default).  Length
    means and throughput cover successful rows; seconds and
    ``time_per_sample`` are those of ``run_id`` (of all rows when None).
    ``evaluation_date`` defaults to the current date.
    """
    ok = F.col("status") == "ok"
    run = F.lit(True) if run_id is None else (F.col("run_id") == run_id)
    in_run = ok & run
    date = F.date_format(F.current_date(), "yyyy-MM-dd") if evaluation_date is None else F.lit(evaluation_date)
    if "model_id" not in scores.columns:
        scores = scores.withColumn("model_id", F.lit(None).cast("string"))
    agg = scores.groupBy("system").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(ok).alias("successful_samples"),
        F.avg(F.when(ok, F.col("rouge1"))).alias("_r1"),
        F.avg(F.when(ok, F.col("rouge2"))).alias("_r2"),
        F.avg(F.when(ok, F.col("rougeL"))).alias("_rl"),
        F.stddev_pop(F.when(ok, F.col("rouge1"))).alias("_s1"),
        F.stddev_pop(F.when(ok, F.col("rouge2"))).alias("_s2"),
        F.stddev_pop(F.when(ok, F.col("rougeL"))).alias("_sl"),
        F.coalesce(F.sum(F.when(run, F.col("seconds"))), F.lit(0.0)).alias("_secs"),
        F.max("model_id").alias("model_id"),
        F.count_if(in_run).alias("_n_run"),
        F.avg(F.when(ok, F.col("input_length"))).alias("_in"),
        F.avg(F.when(ok, F.col("padded_length"))).alias("_pad"),
    )
    overhead = F.when(F.col("_in") > 0, (F.col("_pad") - F.col("_in")) / F.col("_in") * 100) \
                .otherwise(F.lit(0.0))
    return agg.select(
        F.col("system").alias("model_name"), "model_id", date.alias("evaluation_date"),
        "total_samples", "successful_samples",
        (F.col("total_samples") - F.col("successful_samples")).alias("failed_samples"),
        F.round(F.col("successful_samples") / F.col("total_samples") * 100, 2).alias("success_rate"),
        _pct(F.col("_r1"), 2).alias("rouge1_mean"),
        _pct(F.col("_r2"), 2).alias("rouge2_mean"),
        _pct(F.col("_rl"), 2).alias("rougeL_mean"),
        _pct(F.col("_s1"), 2).alias("rouge1_std"),
        _pct(F.col("_s2"), 2).alias("rouge2_std"),
        _pct(F.col("_sl"), 2).alias("rougeL_std"),
        F.round("_secs", 2).alias("evaluation_time_seconds"),
        F.when(F.col("_n_run") > 0, F.round(F.col("_secs") / F.col("_n_run"), 2))
         .otherwise(F.lit(0.0)).alias("time_per_sample"),
        F.round(F.coalesce("_in", F.lit(0.0)), 0).alias("avg_input_length"),
        F.round(F.coalesce("_pad", F.lit(0.0)), 0).alias("avg_padded_length"),
        F.round(overhead, 1).alias("padding_overhead_percent"),
    )


def first_failures(scores: DataFrame, k: int = MAX_ERRORS_PER_SYSTEM) -> DataFrame:
    """First k failure messages (<=100 chars) per system (A3).

    ``row_number() <= k`` lets Spark insert a partial group limit before the
    shuffle, so a system with millions of failures ships only k rows per
    map partition.
    """
    w = Window.partitionBy("system").orderBy("article_id")
    return (scores.filter(F.col("status") == "failed")
                  .select("system", "article_id", F.substring("error", 1, ERROR_CHARS).alias("error"))
                  .withColumn("rn", F.row_number().over(w))
                  .filter(F.col("rn") <= k))


def resume_todo(predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows not scored yet (A6): anti-join on the pair key."""
    return predictions.join(scores.select("system", "article_id"),
                            ["system", "article_id"], "left_anti")


def resume(predictions: DataFrame, scores: DataFrame, run_id: str,
           use_stemmer: bool = True, mode: str = "append") -> DataFrame:
    """Existing scores plus the newly scored remainder; resuming twice equals
    running once because completed pairs are never rescored.
    ``mode="overwrite"`` starts fresh: every pair is scored in this run."""
    if mode not in ("append", "overwrite"):
        raise ValueError(mode)
    if mode == "overwrite":
        return score_predictions(predictions.withColumn("run_id", F.lit(run_id)),
                                 use_stemmer=use_stemmer).select(*scores.columns)
    todo = resume_todo(predictions, scores).withColumn("run_id", F.lit(run_id))
    new = score_predictions(todo, use_stemmer=use_stemmer)
    return scores.unionByName(new.select(*scores.columns))


def run_summary(aggregates: DataFrame) -> DataFrame:
    """Nested run summary (A8): one row with metadata, results, failed names.
    A system with zero successful samples counts as failed.  The input has
    one row per system, so the collected list is bounded by the registry."""
    ok = F.col("successful_samples") > 0
    return aggregates.agg(
        F.struct(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("date"),
            F.count_if(ok).alias("num_models_evaluated"),
            F.count_if(~ok).alias("num_models_failed"),
            F.max("total_samples").alias("test_samples"),
        ).alias("experiment_metadata"),
        F.filter(F.collect_list(F.struct(*aggregates.columns)),
                 lambda r: r["successful_samples"] > 0).alias("results"),
        F.filter(F.collect_list(F.when(~ok, F.col("model_name"))),
                 lambda x: x.isNotNull()).alias("failed_models"))
