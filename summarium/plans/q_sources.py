"""Registered queries: sources / sinks (S*), resume and streaming.

The S* and A7 queries write derived data to a fresh scratch folder under the
shared checkpoint location and return the DataFrame read back from it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs as I
from .registry import register
from .sql_inputs import PREDS, RAW, with_
from .q_corpus import CLEAN
from ..operators import corpus as C
from ..operators import evaluate as EV
from ..sources import files as S
from ..sources.scores import read_score_variants
from ..streaming.resume import score_stream

# The dump's header spelling: stray spaces and a newline, as found in the wild.
DUMP_HEADERS = {"article_id": "article_id", "article": " article_text", "summary": "human_summary\n",
                "headline": "headline ", "category": "news_category", "date": "published_date"}


def _dump_csv(spark, sf):
    raw = I.raw_articles(spark, sf).select(*[F.col(k).alias(v) for k, v in DUMP_HEADERS.items()])
    path = S.scratch_path(spark, "articles-csv")
    S.write_csv(raw, path)
    return path


# The CSV writer writes a null as an unquoted nothing, which reads back as null.
@register("s1_csv", with_(RAW, """
SELECT article_id, article AS article_text, summary AS human_summary, headline,
       category AS news_category, date AS published_date FROM raw_articles"""))
def s1_csv(spark, sf):
    path = _dump_csv(spark, sf)
    schema = S.T.StructType([S.T.StructField("article_id", S.T.LongType())] +
                            [S.T.StructField(n, S.T.StringType()) for n in
                             ("article_text", "human_summary", "headline", "news_category", "published_date")])
    return S.read_articles_csv(spark, path, schema)


@register("p2_headers", with_(RAW, """
SELECT CAST(article_id AS VARCHAR) AS article_id, article, summary, headline, category, date
FROM raw_articles"""))
def p2_headers(spark, sf):
    path = _dump_csv(spark, sf)
    return C.rename_columns(S.read_articles_csv(spark, path))


@register("s2_json", with_(PREDS, """
SELECT *, replace(lower(model_name), '-', '_') AS folder FROM aggregates"""))
def s2_json(spark, sf):
    base = S.scratch_path(spark, "scores-json")
    agg = I.aggregates(spark, sf).withColumn("folder", F.lower(F.regexp_replace("model_name", "-", "_")))
    S.write_json(agg, base, partition_by="folder")
    return S.read_score_folders(spark, base, "part-*.json")   # as Spark names its files


# Three ages of score files, by the length of the name modulo 3.
@register("s2_variant", with_(PREDS, """
SELECT model_name, CASE WHEN age <> 1 THEN model_id END AS model_id, total_samples,
       CASE WHEN age = 0 THEN successful_samples ELSE total_samples END AS successful_samples,
       CASE WHEN age = 0 THEN failed_samples END AS failed_samples, rouge1_mean, rouge2_mean, rougeL_mean,
       rouge2_std, CASE WHEN age < 2 THEN evaluation_time_seconds END AS evaluation_time_seconds,
       CASE age WHEN 0 THEN 'avg_input_length' WHEN 1 THEN 'gpu,note' ELSE 'results_of' END AS unknown
FROM (SELECT *, length(model_name) % 3 AS age FROM aggregates)"""))
def s2_variant(spark, sf):
    """Score files of three ages in one folder, written as JSON and read by paths."""
    base = S.scratch_path(spark, "scores-variant")
    agg = I.aggregates(spark, sf).withColumn("age", F.length("model_name") % 3)
    n = F.col("total_samples")
    of_age = {
        0: agg.where("age = 0").select("model_name", "model_id", "total_samples", "successful_samples", "failed_samples",
                      *[f"{m}_{x}" for m in ("rouge1", "rouge2", "rougeL") for x in ("mean", "std")],
                      "evaluation_time_seconds", "avg_input_length"),
        1: agg.where("age = 1").select(F.col("model_name").alias("model"), n.alias("samples_evaluated"),
                      *[F.col(f"{m}_mean").alias(m) for m in ("rouge1", "rouge2", "rougeL")], "rouge2_std",
                      F.col("evaluation_time_seconds").alias("time_seconds"), F.lit("old run").alias("note"),
                      F.struct(F.lit("T4").alias("name")).alias("gpu")),
        2: agg.where("age = 2").select("model_name", F.col("model_id").alias("checkpoint"), n.cast("string").alias("samples"),
                      F.struct(*[F.struct(F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")).alias(m)
                                 for m in ("rouge1", "rouge2", "rougeL")]).alias("results"),
                      F.array(F.lit(1)).alias("results_of")),
    }
    for age, rows in of_age.items():
        files = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), F.monotonically_increasing_id().alias("folder"))
        files.write.partitionBy("folder").text(f"{base}/age={age}")          # a file holds one system
    found = read_score_variants(spark, f"{base}/*/*/part-*")
    return found.select("model_name", "model_id", "total_samples", "successful_samples", "failed_samples", "rouge1_mean",
                        "rouge2_mean", "rougeL_mean", "rouge2_std", "evaluation_time_seconds",
                        F.array_join("unknown", ",").alias("unknown"))


@register("s5_csv_sink", with_(PREDS, """
SELECT CAST("Rank" AS VARCHAR) AS "Rank", "Model", CAST("ROUGE-1" AS VARCHAR) AS "ROUGE-1",
       CAST("ROUGE-2" AS VARCHAR) AS "ROUGE-2", CAST("ROUGE-L" AS VARCHAR) AS "ROUGE-L",
       CAST("Success Rate" AS VARCHAR) AS "Success Rate", CAST("Time Hours" AS VARCHAR) AS "Time Hours"
FROM ranked"""))
def s5_csv_sink(spark, sf):
    from ..operators import leaderboard as L
    path = S.scratch_path(spark, "leaderboard-csv")
    S.write_csv(L.summary(I.ranked(spark, sf)), path)
    return spark.read.option("header", True).csv(path)


@register("s6_json_sink", with_(PREDS, "SELECT * FROM ranked"))
def s6_json_sink(spark, sf):
    path = S.scratch_path(spark, "leaderboard-json")
    S.write_json(I.ranked(spark, sf), path)
    return spark.read.json(path)


@register("s7_append", with_(PREDS, """
SELECT system, article_id, 'run-1' AS run_id, rouge1, rouge2, rougeL FROM scores"""))
def s7_append(spark, sf):
    path = S.scratch_path(spark, "scores-table")
    scores = I.scores(spark, sf).select("system", "article_id", "run_id", "rouge1", "rouge2", "rougeL")
    S.append_partitioned(scores.filter(F.col("article_id") % 2 == 0), path, part="even")
    for _ in range(2):  # a retried append replaces what the first try wrote
        S.append_partitioned(scores.filter(F.col("article_id") % 2 == 1), path, part="odd")
    return spark.read.parquet(path).drop("part")


@register("s8_ignore", with_(CLEAN, f"""
SELECT article_id, md5('{C.SAMPLE_SEED}:' || CAST(article_id AS VARCHAR)) AS sample_key
FROM clean ORDER BY sample_key LIMIT 100"""))
def s8_ignore(spark, sf):
    path = S.scratch_path(spark, "sample-cache")
    keys = C.clean_keys(I.raw_articles(spark, sf)).select("article_id")
    S.write_if_absent(C.seeded_sample(keys, 100), path)
    # a second write with a different seed leaves the cached sample untouched
    S.write_if_absent(C.seeded_sample(keys, 100, seed=7), path)
    return spark.read.parquet(path)


@register("a6_resume", with_(PREDS, """
SELECT system, article_id, CASE WHEN article_id % 2 = 0 THEN 'run-1' ELSE 'run-2' END AS run_id,
       status, rouge1, rouge2, rougeL
FROM scores"""))
def a6_resume(spark, sf):
    preds = I.predictions(spark, sf)
    previous = EV.score_predictions(preds.filter(F.col("article_id") % 2 == 0),
                                    use_stemmer=False)                 # interrupted run
    full = EV.resume(preds, previous, "run-2", use_stemmer=False)
    return full.select("system", "article_id", "run_id", "status", "rouge1", "rouge2", "rougeL")


@register("a7_stream", with_(PREDS, """
SELECT system, article_id, status, input_length, padded_length, seconds, rouge1, rouge2, rougeL
FROM scores"""))
def a7_stream(spark, sf):
    """Two runs on one checkpoint: a third of the pairs stands in two files of the first
    run, and half of them come again in files of the second.  Files are those of the splits
    of the stored articles, so they grow in number and not in size; a batch takes a quarter
    of them.  The predictions are made for every write from the articles and not staged, and
    their files hold a text that all systems repeat about once: Zstandard looks back over a
    page, Snappy over 64 KB."""
    base = S.scratch_path(spark, "stream")

    def store(df, name):
        df.write.mode("append").option("compression", "zstd").parquet(f"{base}/{name}")

    articles = I.articles(spark, sf, "article_id", "article", "summary")
    store(articles, "articles")
    preds = I.predictions_of(spark, spark.read.schema(articles.schema).parquet(f"{base}/articles"))

    def write(keep):
        store(preds.filter(keep), "predictions")

    def run():
        files = len(spark.read.parquet(f"{base}/predictions").inputFiles())
        return score_stream(spark, f"{base}/predictions", f"{base}/scores", f"{base}/_checkpoint",
                            max_files_per_trigger=max(2, files // 4), use_stemmer=False)

    write(F.col("article_id") % 5 > 0)
    write((F.col("article_id") % 5 > 0) & (F.col("article_id") % 3 == 0))
    run()
    write((F.col("article_id") % 5 == 0) | (F.col("article_id") % 2 == 0))
    scores = run()
    return scores.select("system", "article_id", "status", "input_length", "padded_length",
                         "seconds", "rouge1", "rouge2", "rougeL")


@register("a8_run_summary", with_(PREDS, """
SELECT count(*) FILTER (WHERE successful_samples > 0) AS num_models_evaluated,
       count(*) FILTER (WHERE successful_samples = 0) AS num_models_failed,
       max(total_samples) AS test_samples,
       array_to_string(list_sort(list(model_name || '=' || CAST(successful_samples AS VARCHAR))
                                 FILTER (WHERE successful_samples > 0)), ',') AS results,
       coalesce(array_to_string(list_sort(list(model_name) FILTER (WHERE successful_samples = 0)), ','), '')
         AS failed_models
FROM aggregates"""))
def a8_run_summary(spark, sf):
    """The run summary written as JSON, read back and flattened (without its clock)."""
    path = S.scratch_path(spark, "run-summary")
    S.write_json(EV.run_summary(I.aggregates(spark, sf)), path)
    schema = EV.run_summary(I.aggregates(spark, sf)).schema
    r = spark.read.schema(schema).json(path)
    return r.select(*[F.col(f"experiment_metadata.{c}").alias(c) for c in
                      ("num_models_evaluated", "num_models_failed", "test_samples")],
                    F.array_join(F.array_sort(F.transform("results", lambda x: F.concat_ws(
                        "=", x["model_name"], x["successful_samples"].cast("string")))), ",").alias("results"),
                    F.array_join(F.array_sort("failed_models"), ",").alias("failed_models"))
