"""Registered queries: factuality."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs as I
from .registry import register
from .sql_inputs import PREDS, SEED, rtok, with_
from ..functions.dates import date_mentions, date_mentions_sql
from ..functions.lexicon import GAZETTEER
from ..functions import calendar as CAL
from ..functions.barrier import staged
from ..operators import factuality as FX
from ..operators import latent as LT
from ..operators import phrases as PH
from ..sources.tables import read_table


# --- SQL helpers --------------------------------------------------------------
def _types():
    terms: dict[str, str] = {}
    for t, term in GAZETTEER:
        terms.setdefault(term.lower(), t)
    by_type: dict[str, list[str]] = {}
    for term, t in terms.items():
        by_type.setdefault(t, []).append(term)
    return by_type


def etok_sql(x: str) -> str:
    """Entity tokens of text ``x``; select it into a column before ``ents_sql``."""
    return f"regexp_extract_all({x}, '[A-Za-z0-9]+', 0)"


def ents_sql(x: str, etk: str) -> str:
    """Typed mentions of text ``x`` whose entity tokens are in column ``etk``."""
    by_type = _types()
    allterms = ", ".join(f"'{t}'" for ts in by_type.values() for t in ts)
    case = " ".join(f"WHEN lower(g) IN ({', '.join(repr(t) for t in ts)}) THEN '{ty}'"
                    for ty, ts in by_type.items())
    grams = (f"list_concat({etk}, list_transform(range(1, len({etk})), "
             f"lambda i: {etk}[i] || ' ' || {etk}[i + 1]))")
    named = (f"list_transform(list_filter({grams}, lambda g: lower(g) IN ({allterms})), "
             f"lambda g: {{'ent_type': CASE {case} END, 'ent_text': g}})")
    dates = (f"list_transform({date_mentions_sql(x, 'loose', 'full', distinct=False)}, "
             f"lambda d: {{'ent_type': 'DATE', 'ent_text': d}})")
    return f"list_concat({named}, {dates})"


def ent_str_sql(x: str) -> str:
    return f"array_to_string(list_sort(list_transform({x}, lambda e: e.ent_type || ':' || e.ent_text)), '|')"


ENTITY_CONSISTENCY_SQL = """
CASE WHEN len(se) = 0 THEN 1.0::DOUBLE ELSE least(list_sum(list_transform(se, lambda e:
  CASE WHEN len(list_filter(sr, lambda s: s.ent_type = e.ent_type AND s.ent_text = e.ent_text)) > 0 THEN 1.0::DOUBLE
       WHEN len(list_filter(sr, lambda s: s.ent_type = e.ent_type
                              AND contains(lower(s.ent_text), lower(e.ent_text)))) > 0 THEN 0.5::DOUBLE
       ELSE 0.0::DOUBLE END)) / len(se), 1.0::DOUBLE) END"""


def tf_cosine_cte(name: str, base: str, key: str, a: str, b: str) -> str:
    """CTE ``name(key, semantic)``: TF cosine of token lists a, b via explode."""
    return f"""
{name}_tok AS (
  SELECT {key}, unnest({rtok(a)}) AS tok, 1 AS side FROM {base}
  UNION ALL SELECT {key}, unnest({rtok(b)}) AS tok, 2 AS side FROM {base}),
{name}_tf AS (
  SELECT {key}, tok, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS ta,
         sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS tb
  FROM {name}_tok GROUP BY ALL),
{name}_sum AS (
  SELECT {key}, sum(ta * tb) AS d, sum(ta * ta) AS na, sum(tb * tb) AS nb FROM {name}_tf GROUP BY ALL),
{name} AS (
  SELECT x.{key}, CASE WHEN coalesce(s.na, 0) = 0 OR coalesce(s.nb, 0) = 0 THEN 0.0::DOUBLE
                       ELSE CAST(s.d AS DOUBLE) / (sqrt(s.na) * sqrt(s.nb)) END AS semantic
  FROM {base} x LEFT JOIN {name}_sum s USING ({key}))"""


def _ent_str(col):
    return F.array_join(F.array_sort(F.transform(col, lambda e: F.concat(e["ent_type"], F.lit(":"), e["ent_text"]))), "|")


def _set_str(col):
    return F.array_join(F.array_sort(col), "|")


# --- E1 / E2 ------------------------------------------------------------------
PAIR_ENTS = SEED + f""",
pet AS (SELECT article_id, summary, article, {etok_sql('summary')} AS stk, {etok_sql('article')} AS atk
        FROM articles),
pe AS (
  SELECT article_id AS pair_id, {ents_sql('summary', 'stk')} AS se_all, {ents_sql('article', 'atk')} AS sr_all
  FROM pet),
pe2 AS (SELECT pair_id, se_all AS se, list_distinct(sr_all) AS sr, sr_all FROM pe)"""


@register("e1_entities", with_(PAIR_ENTS, f"""
SELECT pair_id, len(se) AS n_summary_entities, {ent_str_sql('se')} AS summary_entities,
       len(sr_all) AS n_source_entities
FROM pe2"""))
def e1_entities(spark, sf):
    p = I.pairs(spark, sf)
    d = FX.with_entities(p, "summary", "se")
    d = FX.with_entities(d, "source", "sr")
    return d.select("pair_id", F.size("se").cast("bigint").alias("n_summary_entities"),
                    _ent_str(F.col("se")).alias("summary_entities"),
                    F.size("sr").cast("bigint").alias("n_source_entities"))


@register("e2_entity_consistency", with_(PAIR_ENTS, f"""
SELECT pair_id, {ENTITY_CONSISTENCY_SQL} AS entity FROM pe2"""))
def e2_entity_consistency(spark, sf):
    p = I.pairs(spark, sf)
    d = FX.with_entities(p, "summary", "se")
    d = FX.with_entities(d, "source", "sr", distinct=True)
    return d.select("pair_id", FX.entity_consistency("se", "sr").alias("entity"))


def _cues(cues) -> str:
    return ", ".join(f"'{w}'" for w in cues)


_KINDS = list(PH.CUES_BEFORE)
_UNITS_COLUMNS = "words, term, n, " + ", ".join(f"b_{k}" for k in _KINDS)


def _phrases_sql(n: int, units: str) -> str:
    """CTE of the phrases of n words over the units found so far."""
    return f"""
p{n} AS (
  SELECT {_UNITS_COLUMNS}, s AS significance, l AS "left", r AS "right" FROM (
    SELECT x.*, row_number() OVER (PARTITION BY term ORDER BY s DESC, k) AS nth FROM (
      SELECT c.*, k, a.term AS l, b.term AS r,
             (c.n - CAST(a.n * b.n AS DOUBLE) / total) / sqrt(c.n) AS s
      FROM counts c, LATERAL (SELECT unnest(range(1, {n})) AS k), total
      JOIN {units} a ON a.term = array_to_string(string_split(c.term, ' ')[1:k], ' ')
      JOIN {units} b ON b.term = array_to_string(string_split(c.term, ' ')[k + 1:], ' ')
      WHERE c.words = {n} AND c.n >= {PH.MIN_COUNT}) x
    WHERE s >= {PH.SIGNIFICANCE})
  WHERE nth = 1),
u{n} AS (SELECT * FROM {units} UNION ALL SELECT * FROM p{n})"""


_RUNS = " UNION ALL ".join(
    [r"SELECT 1 AS words, lower(w[i]) AS term, regexp_matches(w[i], '^[A-Z]') AS named, before FROM places"]
    + [f"SELECT {n}, lower(array_to_string(w[i:i + {n - 1}], ' ')), TRUE, before FROM places "
       f"WHERE i + {n - 1} <= len(w) AND " + " AND ".join(f"regexp_matches(w[i + {j}], '^[A-Z]')" for j in range(n))
       for n in range(2, PH.MAX_WORDS + 1)])
MINED = SEED + f""",
toks AS (SELECT {etok_sql('article')} AS w FROM articles),
places AS (SELECT w, i, CASE WHEN i > 1 THEN lower(w[i - 1]) END AS before
           FROM toks, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
runs AS ({_RUNS}),
counts AS (
  SELECT words, term, count(*) FILTER (WHERE named) AS n, count(*) AS seen,
         {", ".join(f"count(*) FILTER (WHERE named AND before IN ({_cues(PH.CUES_BEFORE[k])})) AS b_{k}" for k in _KINDS)}
  FROM runs GROUP BY words, term),
total AS (SELECT CAST(sum(seen) AS DOUBLE) AS total FROM counts WHERE words = 1),
u1 AS (SELECT {_UNITS_COLUMNS}, CAST(NULL AS DOUBLE) AS significance, CAST(NULL AS VARCHAR) AS "left",
              CAST(NULL AS VARCHAR) AS "right"
       FROM counts WHERE words = 1 AND n >= {PH.MIN_COUNT} AND n >= {PH.MIN_SHARE} * seen),
{", ".join(_phrases_sql(n, f"u{n - 1}") for n in range(2, PH.MAX_WORDS + 1))},
held AS (SELECT term, sum(n) AS held FROM (
  SELECT unnest(list_distinct(["left", "right"])) AS term, n FROM u{PH.MAX_WORDS} WHERE "left" IS NOT NULL)
  GROUP BY term),
voted AS (
  SELECT u.*, {", ".join(f"b_{k} + CASE WHEN list_has_any(string_split(u.term, ' '), [{_cues(PH.CUES_INSIDE[k])}]) THEN u.n ELSE 0 END AS v_{k}" for k in _KINDS)}
  FROM u{PH.MAX_WORDS} u LEFT JOIN held USING (term) WHERE u.n - coalesce(held, 0) >= {PH.MIN_COUNT}),
mined AS (
  SELECT CASE WHEN greatest({", ".join(f"v_{k}" for k in _KINDS)}) = 0 THEN '{PH.NO_TYPE}'
              {" ".join(f"WHEN v_{k} = greatest({', '.join(f'v_{x}' for x in _KINDS)}) THEN '{k}'" for k in _KINDS)}
         END AS ent_type, term, words, n, significance FROM voted)"""


@register("e1_mined", with_(MINED, """
SELECT ent_type, term, CAST(words AS INTEGER) AS words, n, round(significance, 6) AS significance FROM mined"""))
def e1_mined(spark, sf):
    """The gazetteer mined from the articles."""
    return PH.mine_phrases(I.articles(spark, sf, "article"), "article").withColumn(
        "significance", F.round("significance", 6))


@register("e1_mined_entities", with_(MINED + f""",
grams AS (
  SELECT article_id, w[i:i + n - 1] AS g, n FROM (SELECT article_id, {etok_sql('summary')} AS w FROM articles),
         LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i), LATERAL (SELECT unnest(range(1, {PH.MAX_WORDS} + 1)) AS n)
  WHERE i + n - 1 <= len(w)),
hits AS (SELECT article_id, ent_type FROM grams JOIN mined ON lower(array_to_string(g, ' ')) = term)""", """
SELECT a.article_id AS pair_id, count(ent_type) AS mentions, count(ent_type) FILTER (WHERE ent_type = 'PERSON') AS persons
FROM articles a LEFT JOIN hits USING (article_id) GROUP BY a.article_id"""))
def e1_mined_entities(spark, sf):
    """Mentions of the mined gazetteer in the summaries."""
    a = I.articles(spark, sf, "article_id", "article", "summary")
    mined = staged(PH.mine_phrases(a, "article").select("ent_type", "term"), "mined")
    d = FX.with_entities(a.select("article_id", "summary"), "summary", "found", mined)
    named = F.filter("found", lambda e: e["ent_type"] != "DATE")
    return d.select(F.col("article_id").alias("pair_id"), F.size(named).cast("long").alias("mentions"),
                    F.size(F.filter("found", lambda e: e["ent_type"] == "PERSON")).cast("long").alias("persons"))


# --- E3 / E4 ------------------------------------------------------------------
def _dates_query(patterns):
    sql = with_(SEED, f"""
SELECT article_id AS pair_id,
       array_to_string(list_sort({date_mentions_sql('summary', patterns)}), '|') AS summary_dates,
       array_to_string(list_sort({date_mentions_sql('article', patterns)}), '|') AS source_dates,
       array_to_string(list_sort({date_mentions_sql('summary', patterns, 'full')}), '|') AS summary_dates_full
FROM articles""")

    def build(spark, sf):
        a = I.articles(spark, sf, "article_id", "article", "summary")
        return a.select(F.col("article_id").alias("pair_id"),
                        _set_str(date_mentions("summary", patterns)).alias("summary_dates"),
                        _set_str(date_mentions("article", patterns)).alias("source_dates"),
                        _set_str(date_mentions("summary", patterns, "full")).alias("summary_dates_full"))
    return build, sql


for _p in ("loose", "strict", "extended"):
    _b, _s = _dates_query(_p)
    register(f"e3_dates_{_p}", _s)(_b)


@register("e4_temporal", with_(SEED, f"""
SELECT article_id AS pair_id,
  CASE WHEN len(sd) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(sd, rd)) / len(sd) END AS temporal
FROM (SELECT article_id, {date_mentions_sql('summary')} AS sd, {date_mentions_sql('article')} AS rd FROM articles)"""))
def e4_temporal(spark, sf):
    a = FX.with_dates(I.pairs(spark, sf), {"summary": "sd", "source": "rd"})
    return a.select("pair_id", FX.temporal_consistency("sd", "rd").alias("temporal"))


# The readings in SQL: one step a pattern, each on the text that the last one left.
def _day_sql(y, m, d):
    return (f"(SELECT {{'s': z, 'e': z, 'md': ({m}) * 100 + ({d})}} FROM (SELECT date_diff('day', DATE '1970-01-01', "
            f"TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)) AS z) WHERE z IS NOT NULL)")


def _month_sql(g):
    return f"((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower({g}[1:3])) + 2) // 3)"


_YEAR2 = f"(CASE WHEN length(g3) = 4 THEN CAST(g3 AS INT) WHEN CAST(g3 AS INT) < {CAL.PIVOT} THEN CAST(g3 AS INT) + 2000 ELSE CAST(g3 AS INT) + 1900 END)"
_M1, _M2 = _month_sql("g1"), _month_sql("g2")
_I = {i: f"CAST(g{i} AS INT)" for i in (1, 2, 3)}
_SINCE = "date_diff('day', DATE '1970-01-01', {})"
_READ_SQL = {
    "numeric": f"[{_day_sql(_YEAR2, _I[2], _I[1])}, {_day_sql(_YEAR2, _I[1], _I[2])}]",
    "month_first": f"[{_day_sql(_I[3], _M1, _I[2])}]",
    "day_first": f"[{_day_sql(_I[3], _M2, _I[1])}]",
    "month_year": "[{'s': " + _SINCE.format(f"make_date({_I[2]}, {_M1}, 1)") + ", 'e': "
                  + _SINCE.format(f"last_day(make_date({_I[2]}, {_M1}, 1))") + ", 'md': 0}]",
    "month_day": f"[CASE WHEN TRY_CAST(printf('2000-%02d-%02d', {_M1}, {_I[2]}) AS DATE) IS NOT NULL "
                 f"THEN {{'s': NULL, 'e': NULL, 'md': {_M1} * 100 + {_I[2]}}} END]",
    "year": "[{'s': " + _SINCE.format(f"make_date({_I[1]}, 1, 1)") + ", 'e': "
            + _SINCE.format(f"make_date({_I[1]}, 12, 31)") + ", 'md': 0}]",
}


def _calendar_sql(side: str) -> str:
    """CTEs of the mentions of a text column: (article_id, mention, readings) in {side}_m."""
    steps, last = [f"{side}_0 AS (SELECT article_id, {side} AS t FROM articles)"], f"{side}_0"
    for k, (name, pattern) in enumerate(CAL.PATTERNS.items(), 1):
        steps.append(f"{side}_{k} AS (SELECT article_id, regexp_replace(t, '{pattern}', '{CAL.TAKEN}', 'g') AS t FROM {last})")
        groups = CAL.READERS[name][0]
        each = ", ".join(f"unnest(regexp_extract_all(t, '{pattern}', {i + 1})) AS g{i + 1}" for i in range(groups))
        steps.append(f"{side}_r{k} AS (SELECT article_id, unnest(list_filter({_READ_SQL[name]}, lambda x: x IS NOT NULL)) AS r, "
                     f"mention FROM (SELECT *, '{k}:' || row_number() OVER () AS mention FROM (SELECT article_id, {each} FROM {last})))")
        last = f"{side}_{k}"
    union = " UNION ALL ".join(f"SELECT article_id, mention, r.s AS s, r.e AS e, r.md AS md FROM {side}_r{k}"
                               for k in range(1, len(CAL.PATTERNS) + 1))
    return ", ".join(steps) + f", {side}_m AS ({union})"


@register("e4_calendar", with_(SEED + f""",
{_calendar_sql('summary')}, {_calendar_sql('article')},
tested AS (
  SELECT m.article_id, m.mention, m.s, m.e, m.md,
         max(CASE WHEN (r.s >= m.s AND r.e <= m.e) OR (m.s IS NULL AND r.md = m.md) THEN 2
                  WHEN (r.s <= m.e AND r.e >= m.s) OR (r.s IS NULL AND r.md = m.md) THEN 1 ELSE 0 END) AS v
  FROM summary_m m LEFT JOIN article_m r USING (article_id) GROUP BY ALL),
whole AS (SELECT article_id, mention, max(v) / 2.0::DOUBLE AS v, list_sort(list({{'s': s, 'e': e, 'md': md}})) AS readings
          FROM tested GROUP BY article_id, mention),
once AS (SELECT article_id, readings, any_value(v) AS v FROM whole GROUP BY article_id, readings)""", """
SELECT a.article_id AS pair_id, count(o.v) AS n_summary_dates, round(coalesce(avg(o.v), 1.0), 6) AS calendar
FROM articles a LEFT JOIN once o USING (article_id) GROUP BY a.article_id"""))
def e4_calendar(spark, sf):
    """Temporal consistency of calendar intervals."""
    d = I.pairs(spark, sf)
    d = CAL.with_calendar(CAL.with_calendar(d, "summary", "sd"), "source", "rd")
    return d.select("pair_id", F.size("sd").cast("long").alias("n_summary_dates"),
                    F.round(CAL.calendar_consistency("sd", "rd"), 6).alias("calendar"))


# --- E5 / E6 ------------------------------------------------------------------
DENSE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (
  SELECT d.doc_id, a.e AS a, b.e AS b
  FROM documents d LEFT JOIN v a ON a.vec_id = d.doc_id LEFT JOIN v b ON b.vec_id = d.doc_id + 1),
n AS (
  SELECT doc_id,
    list_reduce(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i]), lambda acc, x: acc + x, 0.0::DOUBLE) AS dt,
    sqrt(list_reduce(a, lambda acc, x: acc + x * x, 0.0::DOUBLE)) *
    sqrt(list_reduce(b, lambda acc, x: acc + x * x, 0.0::DOUBLE)) AS den
  FROM p)
SELECT doc_id, CASE WHEN den IS NULL THEN NULL WHEN den > 0 THEN dt / den ELSE 0.0::DOUBLE END AS cosine FROM n"""


@register("e5_dense_cosine", DENSE_SQL)
def e5_dense_cosine(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id")
    emb = read_table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a = emb.select(F.col("vec_id").alias("doc_id"), F.col("e").alias("a"))
    b = emb.select((F.col("vec_id") - 1).alias("doc_id"), F.col("e").alias("b"))
    j = docs.join(a, "doc_id", "left").join(b, "doc_id", "left")
    return j.select("doc_id", FX.dense_cosine("a", "b").alias("cosine"))


@register("e6_tf_cosine", with_(SEED + "," + tf_cosine_cte("tfc", "articles", "article_id", "summary", "article"),
                                "SELECT article_id AS pair_id, semantic FROM tfc"))
def e6_tf_cosine(spark, sf):
    p = I.pairs(spark, sf)
    return p.select("pair_id", FX.tf_cosine("summary", "source").alias("semantic"))


@register("e6_tfidf_cosine", with_(SEED + f""",
idt AS (SELECT list_distinct({rtok('article')}) AS t FROM articles),
dfq AS (SELECT tok, count(*) AS df FROM (SELECT unnest(t) AS tok FROM idt) GROUP BY tok),
idf AS (SELECT tok, ln((1 + (SELECT count(*) FROM articles)) / (1 + df)) + 1 AS idf FROM dfq),
pt AS (SELECT article_id, unnest({rtok('summary')}) AS tok, 1 AS side FROM articles
       UNION ALL SELECT article_id, unnest({rtok('article')}) AS tok, 2 AS side FROM articles),
tf AS (SELECT article_id, tok, count(*) FILTER (WHERE side = 1) AS ta, count(*) FILTER (WHERE side = 2) AS tb
       FROM pt GROUP BY article_id, tok),
sums AS (SELECT article_id, sum(ta * tb * idf * idf) AS d, sum(pow(ta * idf, 2)) AS na, sum(pow(tb * idf, 2)) AS nb
         FROM tf JOIN idf USING (tok) GROUP BY article_id)""", """
SELECT a.article_id AS pair_id,
       round(CASE WHEN coalesce(s.na, 0) > 0 AND coalesce(s.nb, 0) > 0
                  THEN s.d / (sqrt(s.na) * sqrt(s.nb)) ELSE 0.0 END, 6) AS tfidf_cosine
FROM articles a LEFT JOIN sums s USING (article_id)"""))
def e6_tfidf_cosine(spark, sf):
    a = I.articles(spark, sf, "article_id", "article", "summary")
    r = FX.tfidf_cosine(a, "article_id", "summary", "article")
    return r.select(F.col("article_id").alias("pair_id"), F.round("tfidf_cosine", 6).alias("tfidf_cosine"))


@register("e6_latent_cosine")
def e6_latent_cosine(spark, sf):
    """Cosine of article and summary in the latent space of the articles."""
    p = I.pairs(spark, sf)
    space = LT.fit(p, "source")
    d = LT.latent_cosine(p, "source", "summary", space)
    return d.select("pair_id", F.round("latent_cosine", 6).alias("latent_cosine"))


# --- E7 / E8 ------------------------------------------------------------------
COMPOSITE = PAIR_ENTS + "," + tf_cosine_cte("tfc", "articles", "article_id", "summary", "article") + f""",
parts AS (
  SELECT e.pair_id, {ENTITY_CONSISTENCY_SQL} AS entity,
    CASE WHEN len(d.sd) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(d.sd, d.rd)) / len(d.sd) END AS temporal,
    t.semantic
  FROM pe2 e
  JOIN (SELECT article_id AS pair_id, {date_mentions_sql('summary')} AS sd,
               {date_mentions_sql('article')} AS rd FROM articles) d USING (pair_id)
  JOIN (SELECT article_id AS pair_id, semantic FROM tfc) t USING (pair_id))"""


@register("e7_composite", with_(COMPOSITE, """
SELECT pair_id, round(entity, 3) AS entity, round(temporal, 3) AS temporal,
       round(semantic, 3) AS semantic,
       round(0.4::DOUBLE * entity + 0.3::DOUBLE * temporal + 0.3::DOUBLE * semantic, 3) AS overall
FROM parts"""))
def e7_composite(spark, sf):
    s = FX.factuality_scores(I.pairs(spark, sf))
    return s.select("pair_id", "entity", "temporal", "semantic", "overall")


@register("e8_threshold", with_(COMPOSITE, "SELECT pair_id, semantic >= 0.5 AS semantic_ok FROM parts"))
def e8_threshold(spark, sf):
    return I.pairs(spark, sf).select("pair_id", FX.semantic_ok("summary", "source").alias("semantic_ok"))


# --- E17 / E18 ------------------------------------------------------------------
SYS_PAIRS = PREDS + f""",
sp AS (
  SELECT p.system || '#' || CAST(p.article_id AS VARCHAR) AS k, p.system, p.article_id AS pair_id,
         a.article AS source, p.generated AS summary
  FROM preds2 p JOIN articles a USING (article_id) WHERE p.status = 'ok'),
spt AS (SELECT *, {etok_sql('summary')} AS stk, {etok_sql('source')} AS atk FROM sp),
spe AS (SELECT k, system, {ents_sql('summary', 'stk')} AS se, list_distinct({ents_sql('source', 'atk')}) AS sr,
               {date_mentions_sql('summary')} AS sd, {date_mentions_sql('source')} AS rd FROM spt),
""" + tf_cosine_cte("stf", "sp", "k", "summary", "source") + f""",
sparts AS (
  SELECT e.system, e.k, {ENTITY_CONSISTENCY_SQL} AS entity,
    CASE WHEN len(sd) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(sd, rd)) / len(sd) END AS temporal,
    t.semantic, len(se) AS nse, len(sd) AS nsd
  FROM spe e JOIN stf t USING (k)),
sscored AS (
  SELECT system, round(entity, 3) AS entity, round(temporal, 3) AS temporal, round(semantic, 3) AS semantic,
         round(0.4::DOUBLE * entity + 0.3::DOUBLE * temporal + 0.3::DOUBLE * semantic, 3) AS overall,
         semantic >= 0.5 AS semantic_ok, nse, nsd
  FROM sparts)"""


@register("e17_system_factuality", with_(SYS_PAIRS, """
SELECT system, count(*) AS pairs, round(avg(entity), 6) AS entity, round(avg(temporal), 6) AS temporal,
       round(avg(semantic), 6) AS semantic, round(avg(overall), 6) AS overall,
       count(*) FILTER (WHERE nse > 0) AS entity_applicable,
       count(*) FILTER (WHERE nsd > 0) AS temporal_applicable
FROM sscored GROUP BY system"""))
def e17_system_factuality(spark, sf):
    s = FX.system_factuality(FX.factuality_scores(I.system_pairs(spark, sf)))
    return s.select("system", "pairs", *[F.round(c, 6).alias(c) for c in ("entity", "temporal", "semantic", "overall")],
                    "entity_applicable", "temporal_applicable")


@register("e18_masked_errors", with_(SYS_PAIRS, """
SELECT system, count(*) AS pairs, count(*) FILTER (WHERE semantic_ok) AS similar,
       count(*) FILTER (WHERE semantic_ok AND (entity < 1.0 OR temporal < 1.0)) AS masked_errors,
       round(CASE WHEN count(*) FILTER (WHERE semantic_ok) > 0
             THEN count(*) FILTER (WHERE semantic_ok AND (entity < 1.0 OR temporal < 1.0))
                  / count(*) FILTER (WHERE semantic_ok) ELSE 0.0 END, 6) AS masked_rate
FROM sscored GROUP BY system"""))
def e18_masked_errors(spark, sf):
    m = FX.masked_errors(FX.factuality_scores(I.system_pairs(spark, sf)))
    return m.select("system", "pairs", "similar", "masked_errors", F.round("masked_rate", 6).alias("masked_rate"))
