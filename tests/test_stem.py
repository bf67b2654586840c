from summarium.functions.stem import porter_stem, rouge_stem, stem_vocabulary

# Worked examples of the 1980 paper (fixed values).
PAPER = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
         "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
         "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat",
         "conditional": "condit", "generalizations": "gener", "oscillators": "oscil",
         "replacement": "replac", "adoption": "adopt", "controll": "control", "electrical": "electr"}


def test_paper_examples():
    for w, s in PAPER.items():
        assert porter_stem(w) == s, w


def test_short_tokens_are_not_stemmed():
    assert rouge_stem("cats") == "cat" and rouge_stem("ies") == "ies" and rouge_stem("was") == "was"


def test_vocabulary_job(spark):
    df = spark.createDataFrame([("running",), ("runs",), ("running",), (None,)], "token string")
    got = {r["token"]: r["stem"] for r in stem_vocabulary(df).collect()}
    assert got == {"running": "run", "runs": "run"}


def test_stemming_raises_overlap(spark):
    from summarium.operators.rouge import rouge_scores
    df = spark.createDataFrame([("connections matter", "connected matters")], "reference string, generated string")
    plain = rouge_scores(df, metrics=("rouge1",), use_stemmer=False).first()["rouge1"]
    stemmed = rouge_scores(df, metrics=("rouge1",), use_stemmer=True).first()["rouge1"]
    assert plain == 0.0 and stemmed == 1.0
