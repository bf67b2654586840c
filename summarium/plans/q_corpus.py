"""Registered queries: corpus preparation (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs as I
from .registry import register
from .sql_inputs import RAW, words, with_
from ..operators import corpus as C
from ..sources import files as S
from ..sources.tables import read_table

_NA = ", ".join("'" + v + "'" for v in C.PANDAS_NA_VALUES)

# The date head: its published size, and one below the row count of the small tables.
HEADS = {"": C.TARGET_ARTICLES, "_n500": 500}


def clean_sql(n: int = C.TARGET_ARTICLES) -> str:
    """CTEs of the cleaned corpus, its first n rows by date and their splits."""
    marked = ", ".join(f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END AS {c}" for c in
                       ("headline", "article", "summary", "category", "date", "lang"))
    return RAW + f""",
marked AS (SELECT * REPLACE ({marked}) FROM raw_articles),
dedup AS (
  SELECT min(article_id) AS article_id, count(*) AS copies
  FROM marked GROUP BY headline, article, summary, category, date, lang),
d AS (SELECT r.* FROM marked r JOIN dedup USING (article_id)),
dn AS (SELECT * FROM d WHERE article IS NOT NULL AND summary IS NOT NULL AND headline IS NOT NULL),
wc AS (
  SELECT *, len({words('summary')}) AS summary_word_count,
            len({words('article')}) AS article_word_count
  FROM dn),
clean AS (
  SELECT * FROM wc
  WHERE summary_word_count BETWEEN 50 AND 250 AND article_word_count >= 100
    AND length(headline) >= 10),
pos AS (SELECT *, row_number() OVER (ORDER BY date ASC NULLS LAST, article_id) AS pos FROM clean),
head AS (SELECT * FROM pos WHERE pos <= {n}),
ntot AS (SELECT count(*) AS total FROM head),
cuts AS (SELECT total, floor(0.9::DOUBLE * total) AS e1,
                floor(0.9::DOUBLE * total) + floor(0.05::DOUBLE * total) AS e2 FROM ntot),
splits AS (
  SELECT p.*, CASE WHEN pos <= e1 THEN 'train' WHEN pos <= e2 THEN 'val' ELSE 'test' END AS split,
         CAST(pos - CASE WHEN pos <= e1 THEN 0 WHEN pos <= e2 THEN e1 ELSE e2 END AS BIGINT) AS split_pos
  FROM head p CROSS JOIN cuts)"""


CLEAN = clean_sql()
KEPT = ["article_id", "date", "category", "summary_word_count", "article_word_count"]


def _head(spark, sf, n=C.TARGET_ARTICLES):
    """Narrow rows of the date head, with positions and word counts."""
    keys = C.clean_keys(I.raw_articles(spark, sf))
    return C.head_by_date(C.global_positions(keys, C.chronological(None), KEPT), n)


def _splits(spark, sf, n=C.TARGET_ARTICLES):
    return C.assign_splits(_head(spark, sf, n))


def headed(name, sql):
    """Register a query over the date head for each of its sizes."""
    def deco(fn):
        for suffix, n in HEADS.items():
            def build(spark, sf, n=n):
                return fn(spark, sf, n)
            build.__name__, build.__doc__ = name + suffix, fn.__doc__
            register(name + suffix, sql(n))(build)
        return fn
    return deco


@register("p1_dedup", """
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang, source""")
def p1_dedup(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return C.dedup_keep_first(d, ["text", "lang", "source"], "doc_id").select("doc_id", "copies")


@register("p3_rename", with_(RAW, """
SELECT article_id, headline, category, date, length(article) AS article_chars,
       length(summary) AS summary_chars
FROM raw_articles"""))
def p3_rename(spark, sf):
    raw = I.raw_articles(spark, sf).withColumnsRenamed(
        {v: k for k, v in C.RENAMES.items()})           # the dump's column names
    r = C.rename_columns(raw)
    return r.select("article_id", "headline", "category", "date",
                    F.length("article").alias("article_chars"),
                    F.length("summary").alias("summary_chars"))


@register("p4_dropna", with_(CLEAN, "SELECT article_id FROM dn"))
def p4_dropna(spark, sf):
    return C.content_keys(I.raw_articles(spark, sf)).filter("complete").select("article_id")


@register("p5_word_count", with_(RAW, f"""
SELECT article_id, len({words('summary')}) AS summary_word_count,
       len({words('article')}) AS article_word_count
FROM raw_articles"""))
def p5_word_count(spark, sf):
    w = C.with_word_counts(I.raw_articles(spark, sf))
    return w.select("article_id", "summary_word_count", "article_word_count")


@register("p6_p8_filters", with_(CLEAN, """
SELECT article_id, summary_word_count, article_word_count, length(headline) AS headline_chars
FROM clean"""))
def p6_p8_filters(spark, sf):
    return C.clean_keys(I.raw_articles(spark, sf)).select(
        "article_id", "summary_word_count", "article_word_count", "headline_chars")


@headed("p9_head_by_date", lambda n: with_(clean_sql(n), "SELECT article_id, date, pos FROM head"))
def p9_head_by_date(spark, sf, n):
    return _head(spark, sf, n).select("article_id", "date", "pos")


@register("p10_funnel", with_(CLEAN, f"""
SELECT * FROM (VALUES
  (1, 'initial', (SELECT count(*) FROM marked)),
  (2, 'dedup', (SELECT count(*) FROM d)),
  (3, 'dropna', (SELECT count(*) FROM dn)),
  (4, 'summary_length', (SELECT count(*) FROM wc WHERE summary_word_count BETWEEN 50 AND 250)),
  (5, 'article_length', (SELECT count(*) FROM wc WHERE summary_word_count BETWEEN 50 AND 250
                           AND article_word_count >= 100)),
  (6, 'headline_length', (SELECT count(*) FROM clean)),
  (7, 'head_by_date', (SELECT least(count(*), {C.TARGET_ARTICLES}) FROM clean))
) t(step_no, step, rows)"""))
def p10_funnel(spark, sf):
    return C.funnel(I.raw_articles(spark, sf))


PROFILE_SQL = """
prof AS (
  SELECT count(*) AS total_articles,
         avg(article_word_count) AS avg_words_article,
         avg(summary_word_count) AS avg_words_summary,
         avg(article_word_count) / avg(summary_word_count) AS compression_ratio,
         count(DISTINCT category) AS unique_categories
  FROM head)"""


@headed("p11_profile", lambda n: with_(clean_sql(n) + "," + PROFILE_SQL, """
SELECT total_articles, round(avg_words_article, 6) AS avg_words_article,
       round(avg_words_summary, 6) AS avg_words_summary,
       round(compression_ratio, 6) AS compression_ratio, unique_categories
FROM prof"""))
def p11_profile(spark, sf, n):
    p = C.profile(_head(spark, sf, n))
    return p.select("total_articles", *[F.round(c, 6).alias(c) for c in
                    ("avg_words_article", "avg_words_summary", "compression_ratio")],
                    "unique_categories")


_TGT = ", ".join(f"('{m}', {t}, {tol}, {str(e).lower()})" for m, t, tol, e in C.TARGET_PROFILE)


@headed("p12_targets", lambda n: with_(clean_sql(n) + "," + PROFILE_SQL + f""",
targets(metric, target, tol, exact) AS (VALUES {_TGT}),
long AS (
  SELECT 'total_articles' AS metric, CAST(total_articles AS DOUBLE) AS value FROM prof
  UNION ALL SELECT 'avg_words_article', avg_words_article FROM prof
  UNION ALL SELECT 'avg_words_summary', avg_words_summary FROM prof
  UNION ALL SELECT 'compression_ratio', compression_ratio FROM prof)""", """
SELECT l.metric, round(l.value, 6) AS value, CAST(t.target AS DOUBLE) AS target, CAST(t.tol AS DOUBLE) AS tol,
       CASE WHEN t.exact THEN l.value = t.target ELSE abs(l.value - t.target) < t.tol END AS matches
FROM long l JOIN targets t USING (metric)"""))
def p12_targets(spark, sf, n):
    targets = spark.createDataFrame(C.TARGET_PROFILE, "metric string, target double, tol double, exact boolean")
    r = C.target_check(C.profile(_head(spark, sf, n)), targets)
    return r.select("metric", F.round("value", 6).alias("value"), "target", "tol", "matches")


@headed("p13_split", lambda n: with_(clean_sql(n), "SELECT article_id, pos, split, split_pos FROM splits"))
def p13_split(spark, sf, n):
    return _splits(spark, sf, n).select("article_id", "pos", "split", "split_pos")


_HEADS = " OR ".join(f"(split = '{k}' AND split_pos <= {v})" for k, v in C.SMALL_HEADS.items())


@register("p13_write", with_(CLEAN, """
SELECT article_id, split, split_pos, article, summary FROM splits"""))
def p13_write(spark, sf):
    """The split corpus with its texts, written by split and read back."""
    path = S.scratch_path(spark, "split-corpus")
    C.write_splits(C.split_corpus(_splits(spark, sf), I.raw_articles(spark, sf)), path)
    return spark.read.parquet(path).select("article_id", "split", "split_pos", "article", "summary")


@headed("p14_small_heads", lambda n: with_(
    clean_sql(n), f"SELECT article_id, split, split_pos FROM splits WHERE {_HEADS}"))
def p14_small_heads(spark, sf, n):
    return C.small_heads(_splits(spark, sf, n)).select("article_id", "split", "split_pos")


SAMPLE_N = 100


@register("p15_sample", with_(CLEAN, f"""
SELECT article_id, md5('{C.SAMPLE_SEED}:' || CAST(article_id AS VARCHAR)) AS sample_key
FROM clean ORDER BY sample_key LIMIT {SAMPLE_N}"""))
def p15_sample(spark, sf):
    keys = C.clean_keys(I.raw_articles(spark, sf)).select("article_id")
    return C.seeded_sample(keys, SAMPLE_N)


@headed("p16_cap", lambda n: with_(clean_sql(n), f"""
SELECT article_id, split_pos FROM splits WHERE split = 'test' AND split_pos <= {C.TEST_CAP}"""))
def p16_cap(spark, sf, n):
    return C.test_cap(_splits(spark, sf, n)).select("article_id", "split_pos")


@headed("p17_category_profile", lambda n: with_(clean_sql(n), """
SELECT category, count(*) AS articles,
       round(avg(article_word_count), 6) AS avg_article_words,
       round(avg(summary_word_count), 6) AS avg_summary_words,
       min(article_word_count) AS min_article_words, max(article_word_count) AS max_article_words
FROM head GROUP BY category"""))
def p17_category_profile(spark, sf, n):
    p = C.category_profile(_head(spark, sf, n))
    return p.select("category", "articles",
                    F.round("avg_article_words", 6).alias("avg_article_words"),
                    F.round("avg_summary_words", 6).alias("avg_summary_words"),
                    "min_article_words", "max_article_words")
