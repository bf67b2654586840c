"""Registered queries: leaderboard (L*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs as I
from .registry import register
from .sql_inputs import PREDS, with_
from ..operators import leaderboard as L


@register("l1_l2_project", with_(PREDS, "SELECT * FROM board"))
def l1_l2_project(spark, sf):
    return I.board(spark, sf)


@register("l3_l4_rank", with_(PREDS, 'SELECT CAST("Rank" AS INTEGER) AS "Rank", "Model", "ROUGE-2" FROM ranked'))
def l3_l4_rank(spark, sf):
    return I.ranked(spark, sf).select("Rank", "Model", "`ROUGE-2`")


@register("l5_medal", with_(PREDS, """
SELECT "Rank", "Model", CASE WHEN "Rank" = 1 THEN 'GOLD' WHEN "Rank" = 2 THEN 'SILVER'
                             WHEN "Rank" = 3 THEN 'BRONZE' ELSE '' END AS "Medal"
FROM ranked"""))
def l5_medal(spark, sf):
    return L.with_medal(I.ranked(spark, sf)).select("Rank", "Model", "Medal")


@register("l6_selected", with_(PREDS, """
SELECT "Model", coalesce(contains("Model", 'LED'), false) AS "Selected" FROM board"""))
def l6_selected(spark, sf):
    return L.with_selected(I.board(spark, sf)).select("Model", "Selected")


@register("l7_best", with_(PREDS, """
SELECT (SELECT "Model" FROM ranked WHERE "Rank" = 1) AS best_model,
       (SELECT "ROUGE-2" FROM ranked WHERE "Rank" = 1) AS best_rouge2,
       (SELECT "ROUGE-2 Std" FROM ranked WHERE "Rank" = 1) AS best_rouge2_std,
       (SELECT "Model" FROM board ORDER BY "ROUGE-1" DESC, "Model" LIMIT 1) AS best_rouge1_model,
       (SELECT "Model" FROM board ORDER BY "ROUGE-2" DESC, "Model" LIMIT 1) AS best_rouge2_model,
       (SELECT "Model" FROM board ORDER BY "ROUGE-L" DESC, "Model" LIMIT 1) AS best_rougeL_model"""))
def l7_best(spark, sf):
    return L.best(I.ranked(spark, sf))


@register("l8_totals", with_(PREDS, """
SELECT count(*) AS total_models, count(*) FILTER (WHERE "Success Rate" = 100.0) AS full_success_models,
       sum("Successful") AS total_successful, sum("Failed") AS total_failed,
       round(avg("ROUGE-2"), 2) AS avg_rouge2, round(sum("Time Hours"), 2) AS total_hours
FROM board"""))
def l8_totals(spark, sf):
    return L.totals(I.board(spark, sf))


@register("l9_summary", with_(PREDS, """
SELECT CAST("Rank" AS INTEGER) AS "Rank", "Model", "ROUGE-1", "ROUGE-2", "ROUGE-L",
       "Success Rate", "Time Hours" FROM ranked"""))
def l9_summary(spark, sf):
    return L.summary(I.ranked(spark, sf))


# Assumed in-domain ROUGE-2 of each stand-in system (what-if reference points, not measured).
INDOMAIN = [("Lead-40", 17.5), ("Lead-150", 16.0), ("Mid-60", 12.0),
            ("Long-LED", 18.0), ("Mini-T5", 10.0)]
_IND = ", ".join(f"('{s}', {v})" for s, v in INDOMAIN)


@register("l10_domain_shift", with_(PREDS + f""",
indomain(system, score) AS (VALUES {_IND})""", """
SELECT "Model", CAST(i.score AS DOUBLE) AS indomain, "ROUGE-2" AS outdomain,
       round("ROUGE-2" - i.score, 2) AS delta,
       round(CASE WHEN i.score <> 0 THEN ("ROUGE-2" - i.score) / i.score * 100 END, 1) AS relative_change_pct
FROM board b JOIN indomain i ON b."Model" = i.system"""))
def l10_domain_shift(spark, sf):
    ind = spark.createDataFrame(INDOMAIN, "system string, score double")
    return L.domain_shift(I.board(spark, sf), ind)


@register("l11_extremes", with_(PREDS, """
SELECT (SELECT model_name FROM aggregates ORDER BY time_per_sample, model_name LIMIT 1) AS fastest_model,
       (SELECT min(time_per_sample) FROM aggregates) AS fastest_seconds,
       (SELECT model_name FROM aggregates ORDER BY time_per_sample DESC, model_name LIMIT 1) AS slowest_model,
       (SELECT max(time_per_sample) FROM aggregates) AS slowest_seconds,
       (SELECT round(avg(time_per_sample), 2) FROM aggregates) AS avg_seconds"""))
def l11_extremes(spark, sf):
    return L.speed_extremes(I.aggregates(spark, sf))


PHASES = ("Lead-40", "Long-LED")


@register("l12_phase_compare", with_(PREDS + """,
lm AS (
  SELECT 'rouge1' AS metric, model_name AS phase, rouge1_mean AS value FROM aggregates
  UNION ALL SELECT 'rouge2', model_name, rouge2_mean FROM aggregates
  UNION ALL SELECT 'rougeL', model_name, rougeL_mean FROM aggregates)""", f"""
SELECT b.metric, b.value AS baseline, p.value AS proposed, round(p.value - b.value, 2) AS delta
FROM (SELECT * FROM lm WHERE phase = '{PHASES[0]}') b
JOIN (SELECT * FROM lm WHERE phase = '{PHASES[1]}') p USING (metric)"""))
def l12_phase_compare(spark, sf):
    a = I.aggregates(spark, sf)
    long = a.selectExpr("model_name AS phase", "stack(3, 'rouge1', rouge1_mean, 'rouge2', rouge2_mean, "
                        "'rougeL', rougeL_mean) AS (metric, value)")
    return L.phase_compare(long, *PHASES)


@register("l13_size_pair", with_(PREDS + """,
sizes AS (SELECT system AS "Model", CASE WHEN off = 1 THEN 'lead' ELSE 'offset' END AS family,
                 len AS size FROM systems),
bs AS (SELECT * FROM board JOIN sizes USING ("Model")),
nx AS (SELECT family, "Model" AS small_model, "ROUGE-2" AS small_score,
              lead("Model") OVER (PARTITION BY family ORDER BY size, "Model") AS large_model,
              lead("ROUGE-2") OVER (PARTITION BY family ORDER BY size, "Model") AS large_score
       FROM bs)""", """
SELECT family, small_model, large_model, small_score, large_score,
       round(large_score - small_score, 2) AS delta
FROM nx WHERE large_model IS NOT NULL"""))
def l13_size_pair(spark, sf):
    from ..sources.tables import systems
    sizes = systems(spark).select(
        F.col("system").alias("Model"),
        F.when(F.col("off") == 1, F.lit("lead")).otherwise(F.lit("offset")).alias("family"),
        F.col("len").alias("size"))
    return L.size_pairs(I.board(spark, sf), sizes)


# Systems registered for evaluation but never run (their scores are absent).
EXPECTED_EXTRA = ["Abstractive-Base"]


@register("s3_missing", with_(PREDS + """,
expected AS (SELECT system FROM systems UNION ALL SELECT * FROM (VALUES """
                              + ", ".join(f"('{s}')" for s in EXPECTED_EXTRA) + """) t(system))""", """
SELECT system FROM expected WHERE system NOT IN (SELECT model_name FROM aggregates)"""))
def s3_missing(spark, sf):
    from ..sources.tables import systems
    from ..sources import files as S
    expected = systems(spark).select("system").unionByName(
        spark.createDataFrame([(s,) for s in EXPECTED_EXTRA], "system string"))
    return S.missing_sources(expected, I.aggregates(spark, sf), "system", "model_name")


@register("s4_empty", with_(PREDS, "SELECT count(*) = 0 AS is_empty, count(*) AS systems FROM aggregates"))
def s4_empty(spark, sf):
    a = I.aggregates(spark, sf)
    return a.agg((F.count(F.lit(1)) == 0).alias("is_empty"), F.count(F.lit(1)).alias("systems"))
