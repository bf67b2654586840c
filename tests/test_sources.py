"""Files, sinks, run throughput, start fresh, the evaluation folder rules."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from summarium.operators import evaluate as EV
from summarium.plans import inputs as I
from summarium.sources import files as S
from summarium.sources import tables as T


def test_csv_round_trip_keeps_newlines_quotes_and_nulls(spark, tmp_path):
    rows = [(1, 'a "quoted"\ntext, with commas', None), (2, "", "x")]
    df = spark.createDataFrame(rows, "id int, article string, category string")
    S.write_csv(df.select(F.col("id"), F.col("article").alias(" article\n"), "category"), f"file://{tmp_path}/c")
    back = S.read_articles_csv(spark, f"file://{tmp_path}/c")
    assert back.columns == ["id", "article", "category"]
    got = {r["id"]: r for r in back.collect()}
    assert got["1"]["article"] == rows[0][1] and got["1"]["category"] is None


def test_drifted_score_files_are_not_read(spark, tmp_path):
    folder = tmp_path / "bart_base"
    os.makedirs(folder)
    (folder / "aggregate_scores.json").write_text(json.dumps({"model_name": "BART", "rouge1_mean": 1.5}))
    (folder / "scores.json").write_text(json.dumps({"model": "other", "rouge-1": 9}))
    rows = S.read_score_folders(spark, f"file://{tmp_path}").collect()
    assert [(r["model_name"], r["rouge1_mean"], r["folder"]) for r in rows] == [("BART", 1.5, "bart_base")]


def test_json_append_and_write_if_absent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "system string, x int")
    S.write_json(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2
    S.append_partitioned(df, f"file://{tmp_path}/p")
    S.append_partitioned(df, f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 4
    assert sorted(os.listdir(tmp_path / "p"))[-2:] == ["system=a", "system=b"]
    S.write_if_absent(df, f"file://{tmp_path}/w")
    S.write_if_absent(df.limit(0), f"file://{tmp_path}/w")
    assert spark.read.parquet(f"file://{tmp_path}/w").count() == 2


def test_throughput_is_that_of_the_run(spark):
    scores = spark.createDataFrame([("s", "m", "ok", "r2" if i < 2 else "r1", 1.0, 0.5, 0.5, 0.5, 10, 10) for i in range(10)],
                                   "system string, model_id string, status string, run_id string, seconds double, "
                                   "rouge1 double, rouge2 double, rougeL double, input_length int, padded_length int")
    a = EV.system_aggregates(scores, run_id="r2", evaluation_date="2025-01-01").first()
    assert a["time_per_sample"] == 1.0 and a["evaluation_time_seconds"] == 2.0 and a["total_samples"] == 10
    assert EV.system_aggregates(scores).first()["time_per_sample"] == 1.0
    assert EV.system_aggregates(scores, run_id="none").first()["time_per_sample"] == 0.0
    assert len(a) == 18 and a["model_id"] == "m" and a["evaluation_date"] == "2025-01-01"


def test_run_summary_names_failed_systems(spark):
    agg = spark.createDataFrame([("a", 3, 5), ("b", 0, 5)], "model_name string, successful_samples long, total_samples long")
    r = EV.run_summary(agg).first()
    assert r["failed_models"] == ["b"] and [x["model_name"] for x in r["results"]] == ["a"]
    assert r["experiment_metadata"]["num_models_evaluated"] == 1 and r["experiment_metadata"]["test_samples"] == 5


def test_start_fresh_scores_every_pair_again(spark, sf):
    preds = I.predictions(spark, sf).filter(F.col("article_id") < 20)
    old = EV.score_predictions(preds)
    fresh = EV.resume(preds, old, "r2", mode="overwrite")
    assert fresh.count() == old.count() and fresh.filter("run_id <> 'r2'").count() == 0
    with pytest.raises(ValueError):
        EV.resume(preds, old, "r2", mode="other")


def test_missing_sources(spark):
    want = spark.createDataFrame([("a",), ("b",)], "name string")
    have = spark.createDataFrame([("a",), ("a",)], "folder string")
    assert [r["name"] for r in S.missing_sources(want, have, "name", "folder").collect()] == ["b"]


def test_named_columns_are_all_a_view_builds(spark, sf, monkeypatch):
    monkeypatch.setattr(T, "SPREAD_BYTES", 0)     # a large table is not dealt anew
    plan = T.articles(spark, sf, "article_id", "summary")._jdf.queryExecution().optimizedPlan().toString()
    assert "headline" not in plan and "Chief Minister" not in plan and "Repartition" not in plan
    q = E.queries()
    assert "gazetteer" not in q["e8_threshold"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in q["e10_lexicon_loss"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
