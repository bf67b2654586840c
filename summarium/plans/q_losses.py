"""Registered queries: lexicon / temporal / semantic losses and the staged
loss log (E9-E16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs as I
from .registry import register
from .sql_inputs import SEED, rtok, with_
from .q_factuality import tf_cosine_cte
from ..functions.dates import date_mentions_sql
from ..functions.lexicon import LEXICON_ROWS, LEXICON_TERMS
from ..functions.text import rouge_tokens
from ..operators import losses as LS
from ..sources.tables import read_table

_TERMS = "[" + ", ".join(f"'{t}'" for t in LEXICON_TERMS) + "]"
_LEX_VALUES = ", ".join(f"('{c}', '{t}')" for c, t in LEXICON_ROWS)

TERMS = SEED + f""",
lw AS (SELECT article_id, lower(article) AS la, lower(summary) AS ls,
              {rtok('article')} AS ta, {rtok('summary')} AS ts FROM articles),
lg AS (SELECT article_id, la, ls,
              list_concat(ta, list_transform(range(1, len(ta)), lambda i: ta[i] || ' ' || ta[i + 1])) AS ga,
              list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS gs
       FROM lw),
terms AS (
  SELECT article_id AS pair_id,
         list_filter({_TERMS}, lambda t: contains(la, t)) AS src_sub,
         list_filter({_TERMS}, lambda t: contains(ls, t)) AS sum_sub,
         list_intersect({_TERMS}, ga) AS src_word,
         list_intersect({_TERMS}, gs) AS sum_word
  FROM lg)"""


def _s(c):
    return F.array_join(F.array_sort(F.col(c)), "|")


def _sq(c):
    return f"array_to_string(list_sort({c}), '|')"


def _terms(spark, sf, match):
    p = I.pairs(spark, sf)
    return LS.with_terms(p, {"source": "src", "summary": "sum"}, match)


@register("e9_terms", with_(TERMS, f"SELECT pair_id, {_sq('src_sub')} AS source_terms, {_sq('sum_sub')} AS summary_terms FROM terms"))
def e9_terms(spark, sf):
    return _terms(spark, sf, "substring").select("pair_id", _s("src").alias("source_terms"),
                                                 _s("sum").alias("summary_terms"))


@register("e9_terms_word", with_(TERMS, f"SELECT pair_id, {_sq('src_word')} AS source_terms, {_sq('sum_word')} AS summary_terms FROM terms"))
def e9_terms_word(spark, sf):
    return _terms(spark, sf, "word").select("pair_id", _s("src").alias("source_terms"),
                                            _s("sum").alias("summary_terms"))


# A lexicon of some thousand terms: the words of the benchmark table.
BIG_LEXICON = f"""
lex AS (SELECT DISTINCT w AS term FROM (SELECT unnest({rtok('text')}) AS w FROM benchmark) WHERE length(w) >= 3),
low AS (SELECT article_id, lower(article) AS la, lower(summary) AS ls,
               ' ' || array_to_string({rtok('article')}, ' ') || ' ' AS wa FROM articles),
hits AS (
  SELECT article_id, term, contains(ls, term) AS kept, contains(wa, ' ' || term || ' ') AS whole
  FROM low, lex WHERE contains(la, term)),
sums AS (
  SELECT article_id, count(*) AS n, count(*) FILTER (WHERE kept) AS k, count(*) FILTER (WHERE whole) AS w,
         string_agg(term, '|' ORDER BY term) AS terms
  FROM hits GROUP BY article_id)"""


@register("e9_large_lexicon", with_(SEED + "," + BIG_LEXICON, """
SELECT l.article_id AS pair_id, coalesce(n, 0) AS source_terms, coalesce(k, 0) AS preserved_terms,
       coalesce(w, 0) AS whole_words, md5(coalesce(terms, '')) AS terms_md5
FROM low l LEFT JOIN sums USING (article_id)"""))
def e9_large_lexicon(spark, sf):
    """Terms of a large lexicon in source and summary, by one automaton pass a text."""
    words = read_table(spark, sf, "benchmark").select(F.explode_outer(rouge_tokens("text")).alias("term"))
    lexicon = words.where("length(term) >= 3")
    t = LS.with_terms(I.pairs(spark, sf), {"source": "src", "summary": "sum"}, lexicon=lexicon)
    t = LS.with_terms(t, {"source": "src_w"}, "word", lexicon)
    return t.select("pair_id", F.size("src").cast("long").alias("source_terms"),
                    F.size(F.array_intersect("src", "sum")).cast("long").alias("preserved_terms"),
                    F.size("src_w").cast("long").alias("whole_words"),
                    F.md5(F.array_join("src", "|").cast("binary")).alias("terms_md5"))


def _loss_sql(s, m):
    return f"CASE WHEN len({s}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_intersect({s}, {m})) / len({s}) END"


@register("e10_lexicon_loss", with_(TERMS, f"""
SELECT pair_id, {_loss_sql('src_sub', 'sum_sub')} AS loss_substring,
       {_loss_sql('src_word', 'sum_word')} AS loss_word FROM terms"""))
def e10_lexicon_loss(spark, sf):
    both = LS.with_terms(_terms(spark, sf, "substring"), {"source": "src_w", "summary": "sum_w"}, "word")
    return both.select("pair_id", LS.lexicon_loss("src", "sum").alias("loss_substring"),
                       LS.lexicon_loss("src_w", "sum_w").alias("loss_word"))


@register("e11_drop_report", with_(TERMS + f""",
lex(category, term) AS (VALUES {_LEX_VALUES}),
ex AS (SELECT unnest(src_sub) AS term, sum_sub FROM terms)""", """
SELECT l.category, ex.term, count(*) AS in_source,
       count(*) FILTER (WHERE list_contains(sum_sub, ex.term)) AS preserved,
       count(*) - count(*) FILTER (WHERE list_contains(sum_sub, ex.term)) AS dropped,
       round((count(*) - count(*) FILTER (WHERE list_contains(sum_sub, ex.term))) / count(*), 6) AS drop_rate
FROM ex JOIN lex l USING (term) GROUP BY l.category, ex.term"""))
def e11_drop_report(spark, sf):
    t = _terms(spark, sf, "substring")
    r = LS.drop_report(t, "src", "sum", LS.lexicon_table(spark))
    return r.select("category", "term", "in_source", "preserved", "dropped",
                    F.round("drop_rate", 6).alias("drop_rate"))


@register("e11_most_dropped", with_(TERMS + f""",
lex(category, term) AS (VALUES {_LEX_VALUES}),
ex AS (SELECT unnest(src_sub) AS term, sum_sub FROM terms),
rep AS (SELECT l.category, ex.term,
               count(*) - count(*) FILTER (WHERE list_contains(sum_sub, ex.term)) AS dropped
        FROM ex JOIN lex l USING (term) GROUP BY l.category, ex.term)""", """
SELECT category, term, dropped FROM rep ORDER BY dropped DESC, term, category LIMIT 10"""))
def e11_most_dropped(spark, sf):
    t = _terms(spark, sf, "substring")
    r = LS.drop_report(t, "src", "sum", LS.lexicon_table(spark))
    return LS.most_dropped(r, 10).select("category", "term", "dropped")


@register("e12_hallucination", with_(SEED, f"""
SELECT pair_id,
       CASE WHEN len(sd) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(sd, lambda x: NOT list_contains(rd, x))) / len(sd) END AS temporal_loss,
       array_to_string(list_sort(list_filter(sd, lambda x: NOT list_contains(rd, x))), '|') AS hallucinated_dates
FROM (SELECT article_id AS pair_id, {date_mentions_sql('summary', 'strict')} AS sd,
             {date_mentions_sql('article', 'strict')} AS rd FROM articles)"""))
def e12_hallucination(spark, sf):
    d = LS.with_hallucinated_dates(I.pairs(spark, sf), "summary", "source", "strict")
    return d.select("pair_id", "temporal_loss",
                    F.array_join("hallucinated_dates", "|").alias("hallucinated_dates"))


TRUNC = SEED + """,
trunc AS (SELECT article_id, substr(article, 1, 2000) AS src, substr(summary, 1, 1000) AS gen FROM articles)"""


@register("e13_semantic_loss", with_(TRUNC + "," + tf_cosine_cte("tfc", "trunc", "article_id", "src", "gen"), """
SELECT t.article_id AS pair_id,
       CASE WHEN coalesce(trim(src), '') = '' OR coalesce(trim(gen), '') = '' THEN 0.0::DOUBLE
            ELSE 1.0::DOUBLE - semantic END AS semantic_loss
FROM tfc t JOIN trunc USING (article_id)"""))
def e13_semantic_loss(spark, sf):
    p = I.pairs(spark, sf)
    return p.select("pair_id", LS.semantic_loss("source", "summary").alias("semantic_loss"))


_W_VALUES = ", ".join(f"('{s}', {w['ce']}, {w['entity']}, {w['temporal']}, {w['semantic']})"
                      for s, w in LS.STAGE_WEIGHTS.items())

COMPONENTS = TERMS + "," + """
trunc AS (SELECT article_id, substr(article, 1, 2000) AS src, substr(summary, 1, 1000) AS gen FROM articles),
""" + tf_cosine_cte("tfc", "trunc", "article_id", "src", "gen") + f""",
dts AS (SELECT article_id AS pair_id, {date_mentions_sql('summary', 'strict')} AS sd,
               {date_mentions_sql('article', 'strict')} AS rd FROM articles),
comp AS (
  SELECT t.pair_id, {_loss_sql('src_sub', 'sum_sub')} AS entity_loss,
         CASE WHEN len(sd) = 0 THEN 0.0::DOUBLE
              ELSE len(list_filter(sd, lambda x: NOT list_contains(rd, x))) / len(sd) END AS temporal_loss,
         1.0::DOUBLE - c.semantic AS semantic_loss
  FROM terms t JOIN dts USING (pair_id) JOIN (SELECT article_id AS pair_id, semantic FROM tfc) c USING (pair_id)),
weights(stage, w_ce, w_entity, w_temporal, w_semantic) AS (VALUES {_W_VALUES}),
steps AS (
  SELECT CASE article_id % 3 WHEN 0 THEN 'warmup' WHEN 1 THEN 'factuality' ELSE 'refinement' END AS stage,
         CAST(1 AS BIGINT) AS epoch, CAST(article_id // 3 AS BIGINT) AS batch_idx,
         0.5::DOUBLE + (article_id % 11) / 10.0::DOUBLE AS ce, article_id AS pair_id
  FROM articles),
steplog AS (
  SELECT s.stage, s.epoch, s.batch_idx, (s.batch_idx % 10 = 0 AND s.stage <> 'warmup') AS sampled, s.ce,
         c.entity_loss, c.temporal_loss, c.semantic_loss, w.*
  FROM steps s JOIN comp c USING (pair_id) LEFT JOIN weights w USING (stage)),
steplog2 AS (
  SELECT stage, epoch, batch_idx, sampled, ce,
         CASE WHEN sampled THEN entity_loss ELSE 0.0::DOUBLE END AS entity,
         CASE WHEN sampled THEN temporal_loss ELSE 0.0::DOUBLE END AS temporal,
         CASE WHEN sampled THEN semantic_loss ELSE 0.0::DOUBLE END AS semantic,
         CASE WHEN sampled THEN w_ce * ce + w_entity * entity_loss + w_temporal * temporal_loss
                                + w_semantic * semantic_loss ELSE ce END AS total
  FROM steplog)"""


@register("e14_stage_weights", with_(COMPONENTS, """
SELECT c.pair_id, w.stage,
       round(w.w_ce * (0.5::DOUBLE + (c.pair_id % 11) / 10.0::DOUBLE) + w.w_entity * c.entity_loss
             + w.w_temporal * c.temporal_loss + w.w_semantic * c.semantic_loss, 6) AS total
FROM comp c CROSS JOIN weights w"""))
def e14_stage_weights(spark, sf):
    p = I.pairs(spark, sf).withColumn("ce", F.lit(0.5) + (F.col("pair_id") % 11) / F.lit(10.0))
    comp = LS.component_losses(p, "source", "summary")
    r = LS.stage_what_if(comp, LS.stage_weights_df(spark))
    return r.select("pair_id", "stage", F.round("total", 6).alias("total"))


@register("e15_step_log", with_(COMPONENTS, """
SELECT stage, epoch, batch_idx, sampled, ce, round(entity, 6) AS entity, round(temporal, 6) AS temporal,
       round(semantic, 6) AS semantic, round(total, 6) AS total
FROM steplog2"""))
def e15_step_log(spark, sf):
    log = LS.step_log(I.steps(spark, sf), LS.stage_weights_df(spark))
    return log.select("stage", "epoch", "batch_idx", "sampled", "ce",
                      *[F.round(c, 6).alias(c) for c in ("entity", "temporal", "semantic", "total")])


_PARTS = ("ce", "entity", "temporal", "semantic", "total")


@register("e16_epoch_means", with_(COMPONENTS, "SELECT stage, epoch, count(*) AS steps, count(*) FILTER (WHERE sampled) AS sampled_steps, "
          + ", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in _PARTS) + ", "
          + ", ".join(f"round(avg({c}) FILTER (WHERE sampled), 6) AS {c}_mean_sampled" for c in _PARTS)
          + " FROM steplog2 GROUP BY stage, epoch"))
def e16_epoch_means(spark, sf):
    m = LS.epoch_means(LS.step_log(I.steps(spark, sf), LS.stage_weights_df(spark)))
    return m.select("stage", "epoch", "steps", "sampled_steps",
                    *[F.round(f"{c}_mean", 6).alias(f"{c}_mean") for c in _PARTS],
                    *[F.round(f"{c}_mean_sampled", 6).alias(f"{c}_mean_sampled") for c in _PARTS])
