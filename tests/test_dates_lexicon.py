
from summarium.functions.dates import date_mentions
from summarium.functions.lexicon import LEXICON_TERMS
from summarium.operators.factuality import temporal_consistency
from summarium.operators.losses import hallucination_loss, lexicon_loss, with_terms

# Texts of the reference's two demo blocks.
T1_SUM = "PM Modi announced Rs 20 lakh crore package on May 12, 2020."
T1_SRC = "Prime Minister Narendra Modi announced economic package of Rs 20 lakh crore on May 12, 2020."
T2_SUM = "PM Modi announced package on June 15, 2020."
L_SRC = "The government allocated 5 crore rupees to the IAS training program in Lok Sabha."
L_GOOD = "Government allocated 5 crore for IAS training in Lok Sabha."
L_BAD = "Government allocated 50 million for civil service training."


def dates(spark, text, patterns="loose", mode="reference"):
    df = spark.createDataFrame([(text,)], "t string")
    return set(df.select(date_mentions("t", patterns, mode).alias("d")).first()["d"])


def test_date_patterns(spark):
    assert dates(spark, T1_SUM) == {"2020", "May"}
    assert dates(spark, T2_SUM) == {"2020", "Jun"}
    assert dates(spark, "12/05/2020") == {"12/05/2020", "2020"}
    assert dates(spark, "5 May 2020") == {"2020"}
    assert dates(spark, "id 20201") == {"2020"}
    assert dates(spark, "id 20201", "strict") == set()
    assert dates(spark, "5 May 2020", "extended") == {"2020", "May"}
    assert dates(spark, "on May 12, 2020", mode="full") == {"May 12, 2020", "2020"}


def test_lexicon_has_56_distinct_terms():
    assert len(LEXICON_TERMS) == 56


def test_temporal_and_hallucination(spark):
    rows = [(1, T1_SUM, T1_SRC), (2, T2_SUM, T1_SRC), (3, "on May 12, 2020", "on May 30, 2020"),
            (4, "no dates", "2020")]
    df = spark.createDataFrame(rows, "id int, s string, r string")
    df = df.withColumns({"sd": date_mentions("s"), "rd": date_mentions("r")})
    out = {r["id"]: r for r in df.select("id", temporal_consistency("sd", "rd").alias("t"),
                                         hallucination_loss("sd", "rd").alias("h")).collect()}
    assert (out[1]["t"], out[1]["h"]) == (1.0, 0.0)
    assert (out[2]["t"], out[2]["h"]) == (0.5, 0.5)
    assert out[3]["t"] == 1.0            # the day is not compared (month group only)
    assert (out[4]["t"], out[4]["h"]) == (1.0, 0.0)
    for r in out.values():               # same pattern set: the two sum to 1
        assert r["t"] + r["h"] == 1.0


def terms(spark, text, match):
    df = spark.createDataFrame([(text,)], "t string")
    return set(with_terms(df, {"t": "x"}, match).first()["x"])


def test_lexicon_substring_and_word(spark):
    assert terms(spark, L_SRC, "substring") == {"crore", "ias", "lok sabha", "ed"}
    assert terms(spark, L_SRC, "word") == {"crore", "ias", "lok sabha"}
    assert terms(spark, "employment", "substring") == {"mp"}
    assert terms(spark, "development", "substring") == {"pm"}


def test_lexicon_loss(spark):
    rows = [(L_SRC, L_GOOD), (L_SRC, L_BAD), ("nothing here", "x")]
    df = spark.createDataFrame(rows, "s string, g string")
    for match, expect in (("substring", [0.0, 0.75, 0.0]), ("word", [0.0, 1.0, 0.0])):
        d = with_terms(df, {"s": "st", "g": "gt"}, match)
        got = [r["l"] for r in d.select(lexicon_loss("st", "gt").alias("l")).collect()]
        assert got == expect, match
