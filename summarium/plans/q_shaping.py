"""Registered queries: input shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs as I
from .registry import register
from .sql_inputs import PREDS, SEED, words, with_
from ..operators import evaluate
from ..operators import shaping as SH
from ..operators import subwords as SW
from ..operators.central import central_candidates
from ..sources import tables as T
from ..sources.tables import read_table

_SEP_SQL = "chr(10) || chr(10) || '[DOCUMENT]' || chr(10) || chr(10)"


@register("i1_multidoc", f"""
WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rk
           FROM conversations),
f AS (SELECT * FROM r WHERE rk <= 5)
SELECT conv_id, count(*) AS n_docs, count(text) AS n_used,
       array_to_string(list(text ORDER BY rk) FILTER (WHERE text IS NOT NULL), {_SEP_SQL}) AS input_text
FROM f GROUP BY conv_id""")
def i1_multidoc(spark, sf):
    conv = read_table(spark, sf, "conversations")
    r = SH.multidoc_inputs(conv, "conv_id", ["turn"], "text")
    return r.select("conv_id", "n_docs", F.col("n_used").cast("bigint").alias("n_used"), "input_text")


@register("i2_i3_prefix", with_(PREDS, """
SELECT system, article_id, contains(lower(model_id), 't5') AS t5_prefix, long_ctx AS long_context,
       substr(model_input, 1, 40) AS input_head
FROM preds2"""))
def i2_i3_prefix(spark, sf):
    p = I.predictions(spark, sf)
    return p.select("system", "article_id", SH.is_t5_family("model_id").alias("t5_prefix"),
                    SH.is_long_context("model_id").alias("long_context"),
                    F.substring("model_input", 1, 40).alias("input_head"))


@register("i4_truncate", with_(SEED, """
SELECT article_id, length(substr(article, 1, 3000)) AS chars_3000, length(substr(article, 1, 2000)) AS chars_2000,
       length(substr(summary, 1, 1000)) AS summary_chars_1000, substr(article, 1, 3000) AS article_3000
FROM articles"""))
def i4_truncate(spark, sf):
    a = I.articles(spark, sf, "article_id", "article", "summary")
    return a.select("article_id",
                    F.length(SH.truncate_chars("article", 3000)).alias("chars_3000"),
                    F.length(SH.truncate_chars("article", 2000)).alias("chars_2000"),
                    F.length(SH.truncate_chars("summary", 1000)).alias("summary_chars_1000"),
                    SH.truncate_chars("article", 3000).alias("article_3000"))


@register("i5_preview", with_(SEED, "SELECT article_id, substr(article, 1, 200) || '...' AS preview FROM articles"))
def i5_preview(spark, sf):
    return I.articles(spark, sf, "article_id", "article").select("article_id", SH.preview("article").alias("preview"))


@register("i6_token_len", with_(PREDS, "SELECT system, article_id, input_length FROM preds2"))
def i6_token_len(spark, sf):
    return I.predictions(spark, sf).select("system", "article_id", "input_length")


@register("i7_padding", with_(PREDS, "SELECT system, article_id, input_length, padded_length FROM preds2"))
def i7_padding(spark, sf):
    return I.predictions(spark, sf).select("system", "article_id", "input_length", "padded_length")


VOCAB = SEED + f""",
vt AS (SELECT unnest({words('article')}) AS token FROM articles),
vc AS (SELECT token, count(*) AS freq FROM vt GROUP BY token),
vocab AS (SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS INTEGER) AS token_id FROM vc)"""


def _vocab(spark, sf):
    return SH.build_vocabulary(I.articles(spark, sf, "article"), "article")


def _ids_sql(name, text, max_len):
    """CTE ``name(article_id, ids)``: token ids of the first words of a text."""
    return f"""
{name}_t AS (SELECT article_id, ({words(text)})[1:{max_len}] AS tk FROM articles),
{name}_p AS (SELECT article_id, generate_subscripts(tk, 1) AS pos, unnest(tk) AS token FROM {name}_t),
{name}_i AS (SELECT p.article_id, p.pos, coalesce(v.token_id, 1) AS tid FROM {name}_p p LEFT JOIN vocab v USING (token)),
{name} AS (SELECT a.article_id, coalesce(list(i.tid ORDER BY i.pos) FILTER (WHERE i.tid IS NOT NULL), []) AS ids
           FROM articles a LEFT JOIN {name}_i i USING (article_id) GROUP BY a.article_id)"""


def _pad_sql(ids, n, value):
    return f"array_to_string(list_concat({ids}, list_transform(range({n} - len({ids})), lambda x: {value})), ' ')"


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@register("i8_pairs", with_(VOCAB + "," + _ids_sql("src", "substr(article, 1, 3000)", 1024) + ","
                            + _ids_sql("tgt", "summary", 256), f"""
SELECT s.article_id, {_pad_sql('s.ids', 1024, 0)} AS input_ids, len(s.ids) AS n_real,
       {_pad_sql('t.ids[1:128]', 128, -100)} AS labels_128, {_pad_sql('t.ids', 256, 0)} AS labels_256
FROM src s JOIN tgt t USING (article_id)"""))
def i8_pairs(spark, sf):
    """Training rows of both data sets: the article cut at 3,000 characters and
    1,024 words, the summary as 128 masked and as 256 unmasked labels."""
    a = I.articles(spark, sf, "article_id", "article", "summary")
    e = SH.token_ids(a, "article_id", [("article", 1024, 3000), ("summary", 256, None)], _vocab(spark, sf))
    e = e.withColumn("short", F.slice("ids_1", 1, 128))
    return e.select("article_id", _joined(SH.padded("ids_0", 1024)).alias("input_ids"),
                    F.size("ids_0").cast("bigint").alias("n_real"),
                    _joined(SH.masked_labels("short", 128)).alias("labels_128"),
                    _joined(SH.padded("ids_1", 256)).alias("labels_256"))


@register("i8_vocab", with_(VOCAB, "SELECT token, freq, token_id FROM vocab"))
def i8_vocab(spark, sf):
    return _vocab(spark, sf)


@register("i8_encode", with_(VOCAB + f""",
st AS (SELECT article_id, ({words('summary')})[1:128] AS tk FROM articles),
sp AS (SELECT article_id, generate_subscripts(tk, 1) AS pos, unnest(tk) AS token FROM st),
si AS (SELECT sp.article_id, sp.pos, coalesce(v.token_id, 1) AS tid FROM sp LEFT JOIN vocab v USING (token)),
seq AS (SELECT a.article_id, coalesce(list(si.tid ORDER BY si.pos) FILTER (WHERE si.tid IS NOT NULL), []) AS ids
        FROM articles a LEFT JOIN si USING (article_id) GROUP BY a.article_id)""", """
SELECT article_id,
       array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda x: 0)), ' ') AS input_ids,
       len(ids) AS n_real, 128 - len(ids) AS n_ignored
FROM seq"""))
def i8_encode(spark, sf):
    a = I.articles(spark, sf, "article_id", "summary")
    e = SH.encode_sequences(a, "article_id", "summary", _vocab(spark, sf), 128, mask_labels=True)
    return e.select("article_id",
                    F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("n_real"),
                    F.size(F.filter("labels", lambda x: x == SH.LABEL_IGNORE)).cast("bigint").alias("n_ignored"))


@register("i9_candidates", with_(PREDS, "SELECT system, article_id, generated FROM preds2"))
def i9_candidates(spark, sf):
    return I.predictions(spark, sf).select("system", "article_id", "generated")


@register("i8_subword_encode")
def i8_subword_encode(spark, sf):
    """Articles as subword ids of a public vocabulary, and back to text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    a = I.articles(spark, sf, "article_id", "article")
    e = SW.encode_subwords(a, "article_id", "article", path, SH.MAX_INPUT_TOKENS, mask_labels=True)
    back = SW.subword_text(F.slice("input_ids", 1, F.least("n_subwords", F.lit(SH.MAX_INPUT_TOKENS))), path)
    return e.select("article_id", "n_subwords", F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("kept"),
                    F.md5(F.array_join("input_ids", ",").cast("binary")).alias("ids_md5"),
                    F.md5(F.array_join("labels", ",").cast("binary")).alias("labels_md5"),
                    F.length(back).alias("n_chars"))


@register("i9_central")
def i9_central(spark, sf):
    """Candidates of central sentences, with the length and repetition rules of I10."""
    a = I.articles(spark, sf, "article_id", "article", "summary")
    d = SH.with_constraint_flags(central_candidates(a))
    return d.select("article_id", "system", "generated", F.col("gen_words").cast("long").alias("gen_words"),
                    "len_ok", F.col("repeated_trigrams").cast("long").alias("repeated_trigrams"))


@register("i9_central_sweep")
def i9_central_sweep(spark, sf):
    """The sweep with central sentences as a further system."""
    a = I.articles(spark, sf, "article_id", "article", "summary")
    preds = evaluate.build_predictions(a, T.systems(spark), T.FAILING_SYSTEM, T.FAILING_MODULUS,
                                       candidates=central_candidates(a))
    return evaluate.system_aggregates(evaluate.score_predictions(preds, use_stemmer=False),
                                      evaluation_date=T.EVALUATION_DATE)


@register("i10_constraints", with_(PREDS, f"""
SELECT system, count(*) AS n, count(*) FILTER (WHERE nw BETWEEN 40 AND 150) AS n_len_ok,
       count(*) FILTER (WHERE rep = 0) AS n_no_repeat, sum(rep) AS repeated_trigrams,
       min(nw) AS min_words, max(nw) AS max_words
FROM (SELECT system, len(w) AS nw, len(tri) - len(list_distinct(tri)) AS rep
      FROM (SELECT system, w, list_transform(range(1, len(w) - 1),
                   lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri
            FROM (SELECT system, {words('generated')} AS w FROM preds2 WHERE status = 'ok')))
GROUP BY system"""))
def i10_constraints(spark, sf):
    p = I.predictions(spark, sf).filter(F.col("status") == "ok")
    r = SH.constraint_rates(p)
    return r.select("system", "n", "n_len_ok", "n_no_repeat",
                    F.col("repeated_trigrams").cast("bigint").alias("repeated_trigrams"),
                    F.col("min_words").cast("bigint").alias("min_words"),
                    F.col("max_words").cast("bigint").alias("max_words"))
