"""Latent space against a dense SVD, indexed entity scores, score files of several ages."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from summarium.operators import factuality as FX
from summarium.operators import latent as L
from summarium.sources.scores import read_score_variants


def dense(spark, docs, buckets):
    rows = [r.b for r in docs.select(L.token_buckets("text", buckets).alias("b")).collect() if r.b]
    a = np.zeros((len(rows), buckets))
    for i, b in enumerate(rows):
        np.add.at(a[i], b, 1)
    df = (a > 0).sum(0)
    a *= np.where(df > 0, np.log((1 + len(rows)) / (1 + df)) + 1, 0)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def test_space_equals_the_dense_svd(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    space = L.fit(docs, "text", rank=4, buckets=512, passes=12)
    a = dense(spark, docs, 512)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(space.values, s[:4], rtol=1e-3)
    # the angles between the two spaces
    assert np.linalg.svd(vt[:4] @ space.vectors, compute_uv=False).min() > 0.999
    got = docs.select("doc_id", space.embed("text").alias("v")).limit(20).collect()
    texts = {r.doc_id: r.b for r in docs.select("doc_id", L.token_buckets("text", 512).alias("b")).collect()}
    for r in got:
        x = np.bincount(texts[r.doc_id], minlength=512) * space.idf if texts[r.doc_id] else np.zeros(512)
        x = x / (np.linalg.norm(x) or 1)
        assert np.allclose(r.v, x @ space.vectors, atol=1e-9)


def test_latent_odd_texts(spark):
    df = spark.createDataFrame([(1, "a b c", "a b"), (2, None, "a"), (3, "", ""), (4, "c d", "c d"), (4, "c d", "c d")],
                               "id long, text string, other string")
    space = L.fit(df, "text", rank=3, buckets=64)
    got = {r.id: r.latent_cosine for r in L.latent_cosine(df, "text", "other", space).collect()}
    assert got[2] == got[3] == 0.0 and got[4] == pytest.approx(1.0) and got[1] > 0
    none = L.fit(df.where("false"), "text", rank=3, buckets=64)
    assert {r.latent_cosine for r in L.latent_cosine(df, "text", "other", none).collect()} == {0.0}


def brute_entity(summary, source):
    total = 0.0
    for kind, text in summary:
        if (kind, text) in source:
            total += 1
        elif any(k == kind and text.lower() in t.lower() for k, t in source):
            total += 0.5
    return min(total / len(summary), 1.0) if summary else 1.0


def test_entity_scores_equal_brute_force(spark):
    draw = random.Random(3)

    def mentions(n):
        return [(draw.choice("PO"), "".join(draw.choices("aAb ", k=draw.randrange(1, 5)))) for _ in range(draw.randrange(n))]

    rows = [(i, mentions(6), mentions(9)) for i in range(400)]
    kind = "array<struct<ent_type:string,ent_text:string>>"
    df = spark.createDataFrame(rows, f"i int, s {kind}, r {kind}")
    for r in df.select("i", FX.entity_consistency("s", "r").alias("e")).collect():
        assert r.e == pytest.approx(brute_entity(rows[r.i][1], set(rows[r.i][2])))


def test_score_files_of_several_ages(spark, tmp_path):
    files = {"new": {"model_name": "A", "total_samples": 5, "rouge1_mean": 40.5, "rouge1_std": 1, "failed_samples": 0},
             "old": {"model": "B", "samples_evaluated": 7, "rouge1": "41.25", "time_seconds": 3600, "gpu": {"n": 2}},
             "nested": {"name": "C", "samples": "9", "results": {"rouge1": {"mean": 1, "std": 2}}, "x": [1], "b": None},
             "odd": {"model_name": None, "model": "D", "total_samples": "many", "samples": 3}}
    for name, body in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "scores.json").write_text(json.dumps(body, indent=2))
    for name, text in (("broken", '{"model_name": '), ("list", "[1, 2]"), ("empty", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "scores.json").write_text(text)
    rows = {r.path.split("/")[-2]: r for r in read_score_variants(spark, f"file://{tmp_path}/*/scores.json").collect()}
    assert [rows[n].model_name for n in files] == ["A", "B", "C", "D"]
    assert [rows[n].total_samples for n in files] == [5, 7, 9, 3]
    assert [rows[n].rouge1_mean for n in files] == [40.5, 41.25, 1.0, None]
    assert rows["new"].rouge1_std == 1.0 and rows["nested"].rouge1_std == 2.0
    assert rows["old"].evaluation_time_seconds == 3600.0
    assert rows["old"].unknown == ["gpu"] and json.loads(rows["old"].extra) == {"gpu": {"n": 2}}
    assert rows["nested"].unknown == ["b", "x"] and rows["new"].unknown == []
    for name in ("broken", "list"):
        assert not rows[name].valid and rows[name].model_name is None
    assert all(rows[n].valid for n in files)
