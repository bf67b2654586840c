from pyspark.sql import functions as F

from summarium.operators import corpus as C
from summarium.operators import shaping as SH


def test_padding_lengths(spark):
    df = spark.createDataFrame([(1,), (512,), (513,), (1024,)], "n int")
    got = [r["p"] for r in df.select(SH.padded_length("n", F.lit(True)).alias("p")).collect()]
    assert got == [512, 512, 1024, 1536]
    same = [r["p"] for r in df.select(SH.padded_length("n", F.lit(False)).alias("p")).collect()]
    assert same == [1, 512, 513, 1024]


def test_prefix_and_long_context_flags(spark):
    df = spark.createDataFrame([("google/mt5-base",), ("allenai/led-large",), ("facebook/bart",)], "m string")
    rows = df.select(SH.with_task_prefix(F.lit("x"), "m").alias("i"),
                     SH.is_long_context("m").alias("l")).collect()
    assert [r["i"] for r in rows] == ["summarize: x", "x", "x"]
    assert [r["l"] for r in rows] == [False, True, False]


def test_multidoc_order_cap_and_nulls(spark):
    rows = [(1, t, f"d{t}") for t in range(7)] + [(2, 1, None), (2, 0, "only")]
    df = spark.createDataFrame(rows, "ev int, turn int, text string")
    out = {r["ev"]: r for r in SH.multidoc_inputs(df, "ev", ["turn"], "text").collect()}
    assert out[1]["input_text"] == SH.DOC_SEPARATOR.join(f"d{t}" for t in range(5))
    assert (out[1]["n_docs"], out[1]["n_used"]) == (5, 5)
    assert out[2]["input_text"] == "only" and out[2]["n_used"] == 1


def test_encode_pads_masks_and_labels(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "zzz")], "id int, t string")
    vocab = SH.build_vocabulary(docs.filter("id = 1"), "t")
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert ids == {"a": 2, "b": 3, "c": 4}
    enc = {r["id"]: r for r in SH.encode_sequences(docs, "id", "t", vocab, 6, mask_labels=True).collect()}
    assert enc[1]["input_ids"] == [2, 3, 2, 4, 0, 0]
    assert enc[1]["attention_mask"] == [1, 1, 1, 1, 0, 0]
    assert enc[1]["labels"] == [2, 3, 2, 4, -100, -100]
    assert enc[2]["input_ids"] == [SH.UNK_ID, 0, 0, 0, 0, 0]


def test_split_sizes_match_reference(spark):
    n = 253930
    df = spark.range(n).select(F.col("id").alias("article_id"),
                               (F.col("id") % 97).cast("string").alias("date"))
    pos = C.global_positions(df, C.chronological(None), ["article_id", "date"])
    sizes = {r["split"]: r["count"] for r in C.assign_splits(pos).groupBy("split").count().collect()}
    assert sizes == {"train": 228537, "val": 12696, "test": 12697}


def test_positions_equal_global_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(5000).select(F.col("id").alias("article_id"),
                                  F.when(F.col("id") % 11 == 0, None)
                                   .otherwise((F.col("id") * 7 % 13).cast("string")).alias("date"))
    order = C.chronological(None)
    mine = C.global_positions(df, order, ["article_id", "date"])
    ref = df.withColumn("pos2", F.row_number().over(Window.orderBy(*order)))
    bad = mine.join(ref, "article_id").filter(F.col("pos") != F.col("pos2")).count()
    assert bad == 0 and mine.count() == 5000


def test_positions_plan_has_no_single_partition_exchange(spark):
    df = spark.range(100).select(F.col("id").alias("article_id"), F.lit("x").alias("date"))
    pos = C.global_positions(df, C.chronological(None), ["article_id", "date"])
    plan = pos._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_dedup_keeps_smallest_id(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None)], "id int, t string")
    out = sorted((r["id"], r["copies"]) for r in C.dedup_keep_first(df, ["t"], "id").collect())
    assert out == [(1, 2), (2, 1), (4, 2)]


def test_funnel_counts(spark):
    rows = [(1, "a headline here", " ".join(["w"] * 120), " ".join(["s"] * 60), "c", "2020"),
            (2, "a headline here", " ".join(["w"] * 120), " ".join(["s"] * 60), "c", "2020"),  # dup of 1
            (3, "short", " ".join(["w"] * 120), " ".join(["s"] * 60), "c", "2020"),
            (4, "a headline here", "NA", " ".join(["s"] * 60), "c", "2021")]
    df = spark.createDataFrame(rows, "article_id int, headline string, article string, summary string, "
                                     "category string, date string")
    f = {r["step"]: r["rows"] for r in C.funnel(df).collect()}
    assert f == {"initial": 4, "dedup": 3, "dropna": 2, "summary_length": 2, "article_length": 2,
                 "headline_length": 1, "head_by_date": 1}


def test_seeded_sample_is_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "article_id")
    a = [r["article_id"] for r in C.seeded_sample(df, 50).collect()]
    b = [r["article_id"] for r in C.seeded_sample(df, 50).collect()]
    assert a == b and len(set(a)) == 50


def test_markers_are_nulls_before_the_dedup(spark):
    text, summary = " ".join(["w"] * 120), " ".join(["s"] * 60)
    rows = [(1, "a headline here", text, summary, "NA", "2020"), (2, "a headline here", text, summary, None, "2020"),
            (3, "a headline here", text, summary, "N/A", "nan"), (4, "a headline here", text, summary, "sport", "2020")]
    raw = spark.createDataFrame(rows, "article_id int, headline string, article string, summary string, "
                                      "category string, date string")
    keys = {r["article_id"]: r for r in C.clean_keys(raw).collect()}
    assert set(keys) == {1, 3, 4} and keys[1]["copies"] == 2 and keys[3]["date"] is None
    assert C.profile(C.clean_keys(raw)).first()["unique_categories"] == 1
    assert sorted(r["article_id"] for r in C.clean(raw).collect()) == [1, 3, 4]


def test_cleaning_moves_no_text(spark):
    raw = spark.createDataFrame([], "article_id int, headline string, article string, summary string, "
                                    "category string, date string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (C.clean_keys(raw), C.funnel(raw), C.category_profile(C.clean_keys(raw))):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan
            top = plan[:plan.index("Aggregate [_h")] if "Aggregate [_h" in plan else plan
            assert "article#" not in top and "summary#" not in top and "headline#" not in top
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_sample_is_not_taken_in_one_task(spark):
    df = spark.range(2000).withColumnRenamed("id", "article_id")
    plan = C.seeded_sample(df, 1500)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    assert C.seeded_sample(df, 5000).count() == 2000
