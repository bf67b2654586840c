
from summarium.functions.text import all_ngrams, bigrams, ngrams, rouge_tokens, word_count


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


def test_word_count_matches_python_split(spark):
    for s in ["", "   ", "a b  c", "\nx\ty \n", "one"]:
        assert one(spark, word_count("t"), t=s) == len(s.split())


def test_word_count_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(word_count("t").alias("n")).first()["n"] is None


def test_rouge_tokens(spark):
    assert one(spark, rouge_tokens("t"), t="The CAT's 2 hats, é-accent!") == \
        ["the", "cat", "s", "2", "hats", "accent"]


def test_ngrams_and_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "t array<string>")
    rows = df.select(ngrams("t", 3).alias("g3"), bigrams("t").alias("g2"),
                     all_ngrams("t", 2).alias("ga")).collect()
    assert rows[0]["g3"] == ["a b c", "b c d"]
    assert rows[0]["g2"] == ["a b", "b c", "c d"]
    assert rows[0]["ga"] == ["a", "b", "c", "d", "a b", "b c", "c d"]
    assert rows[1]["g2"] == [] and rows[1]["g3"] == []
    assert rows[2]["g2"] == [] and rows[2]["ga"] == []
