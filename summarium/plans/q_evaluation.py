"""Registered queries: ROUGE (M*) and evaluation aggregates (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs as I
from .registry import register
from .q_corpus import _splits, clean_sql
from .sql_inputs import PREDS, SEED, rtok, with_
from ..functions.text import rouge_tokens
from ..operators import corpus as C
from ..operators import evaluate
from ..sources.tables import EVALUATION_DATE


@register("m1_tokens", with_(SEED, f"""
SELECT article_id, len({rtok('summary')}) AS n_tokens,
       array_to_string({rtok('summary')}, ' ') AS tokens
FROM articles"""))
def m1_tokens(spark, sf):
    a = I.articles(spark, sf, "article_id", "summary")
    t = rouge_tokens("summary")
    return a.select("article_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.array_join(t, " ").alias("tokens"))


def _metric_query(metric):
    def build(spark, sf):
        from ..operators.rouge import rouge_scores
        p = I.predictions(spark, sf)
        p = p.withColumn("generated", F.when(F.col("status") == "ok", F.col("generated")))
        s = rouge_scores(p, metrics=(metric,), keep_pr=True, use_stemmer=False)
        return s.select("system", "article_id", f"{metric}_p", f"{metric}_r", metric)
    sql = with_(PREDS, f"SELECT system, article_id, {metric}_p, {metric}_r, {metric} FROM scores")
    return build, sql


for _name, _metric in (("m3_rouge1", "rouge1"), ("m4_rouge2", "rouge2"), ("m5_rougel", "rougeL")):
    _b, _s = _metric_query(_metric)
    register(_name, _s)(_b)


@register("m6_results", with_(PREDS, """
SELECT system, article_id, status, substr(model_input, 1, 200) || '...' AS article_preview,
       input_length, padded_length,
       round(rouge1, 4) AS rouge1_r4, round(rouge2, 4) AS rouge2_r4, round(rougeL, 4) AS rougeL_r4
FROM scores"""))
def m6_results(spark, sf):
    s = I.scores(spark, sf)
    return s.select("system", "article_id", "status", "article_preview",
                    F.col("input_length").cast("bigint").alias("input_length"),
                    F.col("padded_length").cast("bigint").alias("padded_length"),
                    "rouge1_r4", "rouge2_r4", "rougeL_r4")


@register("a1_rouge_stats", with_(PREDS, """
SELECT model_name, rouge1_mean, rouge2_mean, rougeL_mean, rouge1_std, rouge2_std, rougeL_std
FROM aggregates"""))
def a1_rouge_stats(spark, sf):
    return I.aggregates(spark, sf).select(
        "model_name", "rouge1_mean", "rouge2_mean", "rougeL_mean",
        "rouge1_std", "rouge2_std", "rougeL_std")


@register("a2_success", with_(PREDS, """
SELECT model_name, total_samples, successful_samples, failed_samples, success_rate
FROM aggregates"""))
def a2_success(spark, sf):
    return I.aggregates(spark, sf).select(
        "model_name", "total_samples", "successful_samples", "failed_samples", "success_rate")


@register("a3_failures", with_(PREDS, """
SELECT system, article_id, error, rn FROM (
  SELECT system, article_id, substr(error, 1, 100) AS error,
         row_number() OVER (PARTITION BY system ORDER BY article_id) AS rn
  FROM preds2 WHERE status = 'failed')
WHERE rn <= 5"""))
def a3_failures(spark, sf):
    r = evaluate.first_failures(I.predictions(spark, sf))
    return r.select("system", "article_id", "error", F.col("rn").cast("bigint").alias("rn"))


@register("a4_padding_overhead", with_(PREDS, """
SELECT model_name, avg_input_length, avg_padded_length, padding_overhead_percent
FROM aggregates"""))
def a4_padding_overhead(spark, sf):
    return I.aggregates(spark, sf).select(
        "model_name", "avg_input_length", "avg_padded_length", "padding_overhead_percent")


@register("a5_throughput", with_(PREDS, """
SELECT model_name, evaluation_time_seconds, time_per_sample FROM aggregates"""))
def a5_throughput(spark, sf):
    return I.aggregates(spark, sf).select("model_name", "evaluation_time_seconds", "time_per_sample")


@register("a9_sweep", with_(PREDS, "SELECT * FROM aggregates"))
def a9_sweep(spark, sf):
    return I.aggregates(spark, sf)


# The evaluation reads the capped test split of the prepared corpus.
_CAPPED = PREDS.removeprefix(SEED).replace("FROM articles a CROSS JOIN systems s", f"""
  FROM (SELECT * FROM articles JOIN (SELECT article_id FROM splits
        WHERE split = 'test' AND split_pos <= {C.TEST_CAP}) USING (article_id)) a CROSS JOIN systems s""")


@register("a9_test_cap", with_(clean_sql() + _CAPPED, "SELECT * FROM aggregates"))
def a9_test_cap(spark, sf):
    """The sweep over the capped test split."""
    preds = I.predictions(spark, sf, only=C.test_cap(_splits(spark, sf)))
    return evaluate.system_aggregates(evaluate.score_predictions(preds, use_stemmer=False),
                                      evaluation_date=EVALUATION_DATE)


@register("m2_stem")
def m2_stem(spark, sf):
    """Distinct words of the reference summaries and of the candidates, with
    their Porter stems."""
    from ..functions.stem import stem_vocabulary
    p = I.predictions(spark, sf)
    both = F.concat(rouge_tokens("reference"), F.coalesce(rouge_tokens("generated"),
                                                          F.array().cast("array<string>")))
    return stem_vocabulary(p.select(F.explode_outer(both).alias("token")))


@register("m2_rouge_stemmed")
def m2_rouge_stemmed(spark, sf):
    """The sweep with stemmed tokens, as the reference scorer is configured."""
    return I.aggregates(spark, sf, use_stemmer=True)
