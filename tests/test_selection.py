"""Bottom-k samples, content hashes and appends that may be retried."""

import hashlib

import pytest
from pyspark.sql import functions as F

from summarium.operators import corpus as C
from summarium.sources import files as S


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 2999, 3000, 5000])
def test_sample_is_the_first_n_by_key(spark, monkeypatch, n):
    monkeypatch.setattr(C, "SAMPLE_CUT", 3)
    monkeypatch.setattr(C, "SAMPLE_DIGITS", 1)
    # ids 0 to 2,499, of which 500 stand twice: equal keys are ties
    df = spark.range(2500).union(spark.range(500)).select(F.col("id").alias("article_id"), F.lit("x").alias("t"))
    got = sorted(C.seeded_sample(df.select("article_id"), n).collect())
    ids = [*range(2500), *range(500)]
    want = sorted(sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:n])
    assert [r.article_id for r in got] == want


def test_sample_sorts_no_table(spark):
    plan = C.seeded_sample(spark.range(10 ** 6).select(F.col("id").alias("article_id")), 1000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "Exchange" not in text


def test_sample_of_nothing(spark):
    empty = spark.createDataFrame([], "article_id long, article string")
    assert C.seeded_sample(empty, 5).columns == ["article_id", "article", "sample_key"]
    assert C.seeded_sample(empty, 5).count() == 0


def test_content_hash_tells_all_contents_apart(spark):
    rows = [("a\u0001vb", None), ("a", "b\u0001n"), ("a", None), ("a", ""), (None, "a"), ("", "a"), ("1:a", "n"),
            ("a1:b", ""), ("a", "b"), ("ab", ""), ("n", None), (None, "n"), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(C.content_hash(["x", "y"])).distinct().count() == len(rows)


def test_appending_a_part_again_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([("s", 1), ("t", 2)], "system string, article_id long")
    b = spark.createDataFrame([("s", 3)], "system string, article_id long")
    for df, part in ((a, "run-1"), (b, "run-2"), (b, "run-2"), (a, "run-1")):
        S.append_partitioned(df, path, part=part)
    got = spark.read.parquet(path).select("part", "system", "article_id").collect()
    assert sorted(map(tuple, got)) == [("run-1", "s", 1), ("run-1", "t", 2), ("run-2", "s", 3)]
