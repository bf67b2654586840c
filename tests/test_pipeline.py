import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from summarium.operators import evaluate as EV
from summarium.plans import inputs as I
from summarium.streaming.resume import score_stream

EXPECTED = """p1_dedup p3_rename p4_dropna p5_word_count p6_p8_filters p9_head_by_date p10_funnel
p11_profile p12_targets p13_split p14_small_heads p15_sample p16_cap p17_category_profile i1_multidoc
i2_i3_prefix i4_truncate i5_preview i6_token_len i7_padding i8_vocab i8_encode i9_candidates
i10_constraints m1_tokens m3_rouge1 m4_rouge2 m5_rougel m6_results e1_entities e2_entity_consistency
e3_dates_loose e3_dates_strict e3_dates_extended e4_temporal e5_dense_cosine e6_tf_cosine e7_composite
e8_threshold e9_terms e9_terms_word e10_lexicon_loss e11_drop_report e12_hallucination e13_semantic_loss
e14_stage_weights e15_step_log e16_epoch_means e17_system_factuality e18_masked_errors a1_rouge_stats
a2_success a3_failures a4_padding_overhead a5_throughput a6_resume a9_sweep s3_missing l1_l2_project
l3_l4_rank l5_medal l6_selected l7_best l8_totals l9_summary l10_domain_shift l11_extremes
l12_phase_compare l13_size_pair s1_csv p2_headers s2_json s5_csv_sink s6_json_sink s7_append s8_ignore
a7_stream a8_run_summary i8_pairs p13_write p13_split_n500 p11_profile_n500""".split()
ROWS_ONLY = "m2_stem m2_rouge_stemmed s4_empty".split()


def test_contract_names():
    q, o = E.queries(), E.oracle_sql()
    assert set(EXPECTED) <= set(q) and set(EXPECTED) <= set(o)
    assert set(o) <= set(q)
    missing = [n for n in ROWS_ONLY if n not in q]
    assert missing == [], missing


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and sorted(r["Rank"] for r in rows) == [1, 2, 3, 4, 5]


def test_resume_twice_equals_once(spark, sf):
    preds = I.predictions(spark, sf)
    full = EV.score_predictions(preds).select("system", "article_id", "rouge1")
    part = EV.score_predictions(preds.filter(F.col("article_id") % 3 == 0))
    once = EV.resume(preds, part, "r2")
    twice = EV.resume(preds, once, "r3")
    assert twice.count() == once.count() == full.count()
    assert twice.filter(F.col("run_id") == "r3").count() == 0
    diff = once.select("system", "article_id", "rouge1").exceptAll(full)
    assert diff.count() == 0


def test_stream_scores_each_pair_once(spark, sf):
    base = tempfile.mkdtemp(prefix="summarium-stream-")
    preds = I.predictions(spark, sf)
    preds.repartition(3).write.parquet(f"{base}/p")
    out = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c")
    n = preds.count()
    assert out.count() == n
    assert out.select("system", "article_id").distinct().count() == n
    again = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c")   # resume: nothing new
    assert again.count() == n


def test_first_k_per_group_is_limited_before_the_shuffle(spark, sf):
    plan = E.queries()["a3_failures"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _some_predictions(spark, sf):
    return I.predictions(spark, sf).filter("article_id < 40").coalesce(1).cache()


def test_stream_pairs_repeated_across_files_and_runs(spark, sf):
    """Pairs that stand in several files of a batch, in later batches and in a second run
    on the checkpoint are scored once; another checkpoint leaves the scores alone."""
    base = tempfile.mkdtemp(prefix="summarium-stream-")
    preds = _some_predictions(spark, sf)

    def write(keep):
        preds.filter(keep).write.mode("append").parquet(f"{base}/p")

    for keep in ("article_id < 20", "article_id between 10 and 25", "article_id < 5", "article_id between 24 and 30"):
        write(keep)
    first = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c", max_files_per_trigger=2)
    assert first.count() == first.select("system", "article_id").distinct().count() == 31 * 5
    write("article_id between 20 and 39")
    write("true")
    second = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c", max_files_per_trigger=1)
    assert second.count() == second.select("system", "article_id").distinct().count() == 40 * 5
    want = EV.score_predictions(preds).select("system", "article_id", "status", "rouge1", "rougeL")
    assert second.select(*want.columns).exceptAll(want).count() == 0
    done = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c2", previous=second)
    assert done.count() == 40 * 5


def test_stream_stopped_in_a_batch_resumes(spark, sf, monkeypatch):
    """A batch that fails after its write is run again and replaces it."""
    from summarium.streaming import resume as R

    base = tempfile.mkdtemp(prefix="summarium-stream-")
    preds = _some_predictions(spark, sf)
    for keep in ("article_id < 15", "article_id < 25", "article_id between 5 and 39"):
        preds.filter(keep).write.mode("append").parquet(f"{base}/p")
    seen = []

    def failing(df, use_stemmer=True):
        seen.append(1)
        if len(seen) == 4:  # the schema takes two calls in the first run
            raise RuntimeError("stopped")
        return EV.score_predictions(df, use_stemmer=use_stemmer)

    monkeypatch.setattr(R, "score_predictions", failing)
    try:
        score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c", max_files_per_trigger=1)
        raise AssertionError("the stream should have stopped")
    except Exception as e:  # noqa: BLE001
        assert "stopped" in str(e)
    monkeypatch.undo()
    out = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c", max_files_per_trigger=1)
    assert out.count() == out.select("system", "article_id").distinct().count() == 40 * 5


def test_stream_state_within_a_watermark(spark, sf):
    base = tempfile.mkdtemp(prefix="summarium-stream-")
    preds = _some_predictions(spark, sf)
    for keep in ("article_id < 20", "article_id < 30", "true"):
        preds.filter(keep).write.mode("append").parquet(f"{base}/p")
    out = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c", max_files_per_trigger=1,
                       forget_after="1 hour")
    assert out.count() == out.select("system", "article_id").distinct().count() == 40 * 5


def test_stream_with_state_on_disk(spark, sf):
    from summarium.streaming.resume import ROCKSDB, STORE_CONF

    base = tempfile.mkdtemp(prefix="summarium-stream-")
    preds = _some_predictions(spark, sf)
    for _ in range(2):
        preds.write.mode("append").parquet(f"{base}/p")
    before = spark.conf.get(STORE_CONF)
    spark.conf.set(STORE_CONF, ROCKSDB)
    try:
        out = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c", max_files_per_trigger=1)
        assert out.count() == 40 * 5
    finally:
        spark.conf.set(STORE_CONF, before)


def test_stream_state_gets_no_source_text(spark, sf, monkeypatch):
    from summarium.streaming import resume as R

    base = tempfile.mkdtemp(prefix="summarium-stream-")
    preds = _some_predictions(spark, sf)
    preds.write.parquet(f"{base}/p")
    seen = []

    def looking(df, use_stemmer=True):
        if "source" not in df.columns:
            seen.append(df.agg(F.max(F.length("model_input"))).first()[0])
        return EV.score_predictions(df, use_stemmer=use_stemmer)

    monkeypatch.setattr(R, "score_predictions", looking)
    out = score_stream(spark, f"{base}/p", f"{base}/s", f"{base}/c")
    assert seen == [200] and preds.agg(F.max(F.length("model_input"))).first()[0] > 200
    assert out.count() == 40 * 5


def test_stream_files_grow_in_number(spark, sf):
    """The predictions are written by as many tasks as they have splits."""
    import glob

    from summarium.session import ensure_checkpoint_dir

    key, top = "spark.sql.files.maxPartitionBytes", ensure_checkpoint_dir(spark).removeprefix("file:")
    before = spark.conf.get(key)
    old = set(glob.glob(f"{top}/scratch/stream-*"))
    spark.conf.set(key, "10000")
    try:
        assert E.queries()["a7_stream"](spark, sf).count() == I.predictions(spark, sf).count()
    finally:
        spark.conf.set(key, before)
    new, = set(glob.glob(f"{top}/scratch/stream-*")) - old
    assert len(glob.glob(f"{new}/predictions/part-*")) > 12


def test_stream_keeps_texts_about_once_on_disk(spark, sf):
    """The query stages no copy of the predictions, and its files hold a text that the systems
    repeat about once: all it writes is less than one plain copy of the predictions."""
    import glob
    import os

    from summarium.session import ensure_checkpoint_dir

    top = ensure_checkpoint_dir(spark).removeprefix("file:")

    def written(folder):
        return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))

    plain = tempfile.mkdtemp(prefix="summarium-plain-")
    I.predictions(spark, sf).write.option("compression", "none").parquet(f"{plain}/p")
    old = set(glob.glob(f"{top}/scratch/*"))
    E.queries()["a7_stream"](spark, sf)
    new = set(glob.glob(f"{top}/scratch/*")) - old
    assert [os.path.basename(f).split("-")[0] for f in new] == ["stream"]
    assert sum(map(written, new)) < written(f"{plain}/p")
