
from summarium.operators import factuality as FX
from summarium.operators import losses as LS

ENTS = "array<struct<ent_type:string,ent_text:string>>"


def consistency(spark, se, sr):
    df = spark.createDataFrame([(se, sr)], f"se {ENTS}, sr {ENTS}")
    return df.select(FX.entity_consistency("se", "sr").alias("e")).first()["e"]


def test_entity_consistency_rules(spark):
    p = ("PERSON", "Chief Minister")
    assert consistency(spark, [], [p]) == 1.0
    assert consistency(spark, [p], [p]) == 1.0
    assert consistency(spark, [("PERSON", "minister")], [p]) == 0.5          # lower-case substring
    assert consistency(spark, [("ORG", "Chief Minister")], [p]) == 0.0       # type must match
    assert consistency(spark, [p, ("GPE", "x")], [p]) == 0.5


def test_gazetteer_entities_keep_duplicates(spark):
    df = spark.createDataFrame([("The Chief Minister met the chief minister on 12/05/2020.",)], "t string")
    ents = FX.with_entities(df, "t", "e").first()["e"]
    texts = sorted((e["ent_type"], e["ent_text"]) for e in ents)
    assert ("PERSON", "Chief Minister") in texts and ("PERSON", "chief minister") in texts
    assert texts.count(("GPE", "the")) == 1 and ("GPE", "The") in texts
    assert ("DATE", "12/05/2020") in texts


def test_composite_weights(spark):
    df = spark.createDataFrame([(1, "The Chief Minister spoke.", "The Chief Minister spoke today.")],
                               "pair_id int, summary string, source string")
    r = FX.factuality_scores(df).first()
    assert r["entity"] == 1.0 and r["temporal"] == 1.0
    assert abs(r["overall"] - round(0.4 + 0.3 + 0.3 * r["semantic"], 3)) <= 1e-3


def test_dense_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<double>, b array<double>")
    assert [r["c"] for r in df.select(FX.dense_cosine("a", "b").alias("c")).collect()] == [1.0, 0.0, 0.0]


def test_step_log_sampling_semantics(spark):
    steps = spark.createDataFrame(
        [("warmup", 1, 0, 2.0, "crore on May 1, 2020", "nothing"),
         ("factuality", 1, 0, 2.0, "crore on May 1, 2020", "nothing"),
         ("factuality", 1, 1, 2.0, "crore", "nothing"),
         ("refinement", 1, 10, 1.0, "crore", "crore")],
        "stage string, epoch long, batch_idx long, ce double, source string, generated string")
    log = {(r["stage"], r["batch_idx"]): r for r in LS.step_log(steps, LS.stage_weights_df(spark)).collect()}
    w = log[("warmup", 0)]
    assert (w["sampled"], w["entity"], w["total"]) == (False, 0.0, 2.0)
    f = log[("factuality", 0)]
    assert f["sampled"] and f["entity"] == 1.0
    assert abs(f["total"] - (0.5 * 2.0 + 0.3 * 1.0 + 0.2 * f["temporal"])) < 1e-12
    u = log[("factuality", 1)]
    assert (u["sampled"], u["entity"], u["total"]) == (False, 0.0, 2.0)   # unweighted ce
    m = {r["stage"]: r for r in LS.epoch_means(LS.step_log(steps, LS.stage_weights_df(spark))).collect()}
    assert m["factuality"]["entity_mean"] == 0.5 and m["factuality"]["entity_mean_sampled"] == 1.0


def test_tfidf_cosine(spark):
    corpus = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a dog ran", "the bird flew"),
                                    (3, "", "the end")], "id int, s string, src string")
    got = {r["id"]: r["tfidf_cosine"] for r in FX.tfidf_cosine(corpus, "id", "s", "src").collect()}
    assert abs(got[1] - 1.0) < 1e-12 and got[2] == 0.0 and got[3] == 0.0
    counts = FX.term_counts(corpus, "id", "s", "src")
    w = {r["tok"]: r["idf"] for r in FX.idf_table(counts, 3).collect()}
    assert "dog" not in w                         # no second text has it
    assert w["the"] < w["cat"]                    # common tokens weigh less


def test_gazetteer_size_does_not_change_the_mentions(spark):
    """A list and tables of 3 and 20,000 terms find the same mentions: every type of a
    term, terms of five words, equal texts and rows without a key."""
    small = [("ORG", "bank of the united states"), ("GPE", "springfield"), ("PERSON", "Springfield")]
    large = small + [("ORG", f"filler{i} term{i % 7}") for i in range(20_000)]
    text = "The Bank of the United States met in Springfield, springfield on 12/05/2020."
    df = spark.createDataFrame([(text,), (text,), (None,), ("",), ("nothing here",)], "t string")
    schema = "ent_type string, term string"
    for distinct in (False, True):
        got = [sorted(map(repr, (r["e"] for r in FX.with_entities(df, "t", "e", g, distinct).collect())))
               for g in (small, spark.createDataFrame(small, schema), spark.createDataFrame(large, schema))]
        assert got[0] == got[1] == got[2]
    ents = [tuple(e) for e in FX.with_entities(df.limit(1), "t", "e", spark.createDataFrame(large, schema)).first()["e"]]
    assert ents == [("GPE", "Springfield"), ("PERSON", "Springfield"), ("GPE", "springfield"),
                    ("PERSON", "springfield"), ("ORG", "Bank of the United States"),
                    ("DATE", "12/05/2020"), ("DATE", "2020")]
    scored = FX.factuality_scores(spark.createDataFrame([(1, text, text)], "id int, summary string, source string"),
                                  gazetteer=spark.createDataFrame(large, schema)).first()
    assert scored["entity"] == 1.0 and scored["n_summary_entities"] == 7


def test_semantic_loss_of_empty_text_and_missing_vectors(spark):
    df = spark.createDataFrame([("a b", ""), ("a b", None), ("", "a"), ("a b", "a b"), ("a", "b")], "s string, g string")
    loss = [round(r["l"], 9) for r in df.select(LS.semantic_loss("s", "g").alias("l")).collect()]
    assert loss == [0.0, 0.0, 0.0, 0.0, 1.0]
    v = spark.createDataFrame([([1.0], None), (None, [1.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in v.select(FX.dense_cosine("a", "b").alias("c")).collect()] == [None, None]
