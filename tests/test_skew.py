"""Hot keys: one date / one text holding a third of all rows."""

from pyspark.sql import functions as F

from summarium.operators import corpus as C


def test_positions_split_a_hot_date_across_partitions(spark):
    n = 30000
    df = spark.range(n).select(
        F.col("id").alias("article_id"),
        F.when(F.col("id") % 3 == 0, F.lit("2020-01-01"))
         .otherwise(F.date_format(F.date_add(F.lit("2019-01-01").cast("date"), (F.col("id") % 400).cast("int")),
                                  "yyyy-MM-dd")).alias("date"))
    pos = C.global_positions(df, C.chronological(None), ["article_id", "date"])
    per_part = [r["count"] for r in pos.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(per_part) == parts
    assert max(per_part) < 2 * n / parts            # the hot date does not land in one task
    stats = pos.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                    F.countDistinct("pos").alias("d")).first()
    assert (stats["lo"], stats["hi"], stats["d"]) == (1, n, n)
    # rows of the hot date are numbered consecutively by id after the dates before it
    hot = pos.filter(F.col("date") == "2020-01-01").agg(F.min("pos"), F.max("pos"), F.count("*")).first()
    assert hot[1] - hot[0] + 1 == hot[2] and hot[2] >= n // 3


def test_dedup_with_a_text_copied_into_a_third_of_rows(spark):
    n = 30000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("same text"))
                               .otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("t"))
    kept = C.dedup_keep_first(df, ["t"], "id")
    assert kept.count() == n - n // 3 + 1
    hot = kept.filter(F.col("t") == "same text").first()
    assert (hot["id"], hot["copies"]) == (0, n // 3)
    plan = C.dedup_keep_first(df, ["t"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan                    # map-side combine before the shuffle


def test_tfidf_with_a_token_in_every_pair_and_no_broadcast(spark):
    from summarium.operators import factuality as FX
    n = 2000
    df = spark.range(n).select(F.col("id"), F.concat(F.lit("the the w"), F.col("id")).alias("a"),
                               F.concat(F.lit("the w"), F.col("id") % 50).alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = {r["id"]: r["tfidf_cosine"] for r in FX.tfidf_cosine(df, "id", "a", "b").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = FX.tfidf_cosine(df, "id", "a", "b")
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["tfidf_cosine"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == n and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert got[7] > got[1007] > 0      # w7 is shared, w1007 is not in any second text


def test_tfidf_of_repeated_keys_and_a_divided_idf_table(spark):
    """Rows of a key are one pair, null is a key; the sums are those of plain Python, however
    many tokens are looked up apart."""
    import math
    from collections import Counter

    from summarium.operators import factuality as FX
    rows = [(i % 40, f"w{i % 7} w{i % 11} the the", f"the w{i % 5} w{i % 13} v{i}") for i in range(60)]
    rows += [(None, "the w1", "w1 v1"), (None, "w1", ""), (50, "", ""), (51, "none of these", "the"), (52, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(5)
    a, b = {}, {}
    for k, x, y in rows:
        a.setdefault(k, Counter()).update((x or "").split())
        b.setdefault(k, Counter()).update((y or "").split())
    df_of = Counter(t for c in b.values() for t in c)
    n = len(a) - 1                                  # a null id is none of the N
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df_of.items()}
    want = {}
    for k in a:
        na, nb = [sum((v * idf.get(t, 0)) ** 2 for t, v in c.items()) for c in (a[k], b[k])]
        dot = sum(v * b[k][t] * idf.get(t, 0) ** 2 for t, v in a[k].items())
        want[k] = dot / math.sqrt(na) / math.sqrt(nb) if na > 0 and nb > 0 else 0.0
    for frequent in (1, 5, 100_000):
        got = FX.tfidf_cosine(df, "id", "a", "b", frequent=frequent).collect()
        assert len(got) == len(want)
        assert all(abs(r["tfidf_cosine"] - want[r["id"]]) < 1e-9 for r in got)


def test_tfidf_counts_leave_no_row_for_a_token(spark):
    """Keys that do not repeat are counted in place: nothing is shuffled by token."""
    from summarium.operators import factuality as FX
    df = spark.range(100).select("id", F.lit("a b").alias("a"), F.lit("a c").alias("b"))
    rows = FX.row_terms(df, "id", "a", "b")
    assert "Exchange" not in FX.counts_of_rows(rows, "id", False)._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 100
