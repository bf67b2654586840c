import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from summarium.functions.kernels import clipped_overlap, lcs_length, tf_cosine
from summarium.operators.rouge import rouge_scores


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, start=1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_bit_parallel_lcs_equals_dp(a, b):
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_lcs_long_sequences():
    rnd = random.Random(7)
    a = [rnd.choice("abcdefgh") for _ in range(700)]
    b = [rnd.choice("abcdefgh") for _ in range(300)]
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_clipped_overlap_is_multiset_min():
    assert clipped_overlap(list("aab"), list("abbb"), 1) == 2
    assert clipped_overlap(list("aaa"), list("aa"), 2) == 1
    assert clipped_overlap([], list("ab"), 1) == 0


def test_tf_cosine():
    assert abs(tf_cosine(["a", "b"], ["a", "b"]) - 1.0) < 1e-12
    assert tf_cosine(["a"], ["b"]) == 0.0
    assert tf_cosine([], ["b"]) == 0.0


def score(spark, rows):
    df = spark.createDataFrame(rows, "id int, reference string, generated string")
    return {r["id"]: r for r in rouge_scores(df, keep_pr=True).collect()}


def test_identity_scores_one(spark):
    r = score(spark, [(1, "the cat sat on the mat", "The cat sat on the mat.")])[1]
    assert r["rouge1"] == r["rouge2"] == r["rougeL"] == 1.0


def test_hand_example(spark):
    # ref: the cat sat on the mat (6) ; gen: the cat on the mat today (6)
    r = score(spark, [(1, "the cat sat on the mat", "the cat on the mat today")])[1]
    assert r["rouge1_p"] == 5 / 6 and r["rouge1_r"] == 5 / 6
    assert r["rouge2_p"] == 3 / 5            # the cat, on the, the mat
    assert r["rougeL_r"] == 5 / 6            # the cat on the mat


def test_swapping_sides_swaps_p_and_r(spark):
    a, b = "one two three four five", "two three six"
    s = score(spark, [(1, a, b), (2, b, a)])
    for m in ("rouge1", "rouge2", "rougeL"):
        assert s[1][f"{m}_p"] == s[2][f"{m}_r"]
        assert s[1][m] == s[2][m]


def test_empty_and_null(spark):
    s = score(spark, [(1, "", "something"), (2, None, "x"), (3, "a", None)])
    assert s[1]["rouge1"] == 0.0 and s[1]["rougeL"] == 0.0
    assert s[2]["rouge1"] is None and s[3]["rougeL"] is None


def test_rouge_plan_has_no_shuffle(spark):
    df = spark.range(100).select(F.col("id"), F.lit("a b c").alias("reference"),
                                 F.lit("a c").alias("generated"))
    plan = rouge_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
