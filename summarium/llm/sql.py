"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import level_products as lv
from . import license_votes as lic
from . import poisson_mix as mix
from . import spaced_seeds as seeds

ORACLES: dict[str, str] = {}

ORACLES["op10_nra_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.id AS query_id, d.id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v d ON q.r <> d.r WHERE q.id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_MIX_KEY = "coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))"
ORACLES["op6_poisson_mix"] = f"""
WITH sizes AS (
  SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS all_size, sum(pow(size, {mix.ALPHA})) AS all_weight FROM sizes),
rates AS (
  SELECT source, (all_size / all_weight) * pow(size, {mix.ALPHA}) / size AS rate FROM sizes, totals),
cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k)),
drawn AS (
  SELECT *, CAST('0x' || substr(md5('{mix.SEED}:' || {_MIX_KEY}), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, any_value({_MIX_KEY}) AS key, d.rowid_ AS r, count(*) AS n
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM drawn) d
  JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u
  GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('{mix.SEED}:order:' || key || ':' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(1, n + 1)) AS copy)
"""


#: Without masks: 3 words in a row are equal wherever an item's rule is met.
_SEED_ROWS = ("SELECT id, p - 1 AS p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS seed FROM {t}, "
              "LATERAL (SELECT unnest(range(1, len(w) - 1)) AS p)")
_SEED_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
ORACLES["op5_spaced_seeds"] = f"""
WITH i AS (SELECT DISTINCT item_id AS id, {_SEED_WORDS} AS w FROM benchmark WHERE len({_SEED_WORDS}) >= {seeds.LEAST}),
d AS (SELECT DISTINCT doc_id AS id, {_SEED_WORDS} AS w FROM documents),
si AS ({_SEED_ROWS.format(t='i')}),
sd AS ({_SEED_ROWS.format(t='d')}),
hits AS (
  SELECT DISTINCT sd.id AS doc_id, si.id AS item_id, sd.p - si.p AS start
  FROM sd JOIN si ON sd.seed = si.seed),
laid AS (
  SELECT h.doc_id, h.item_id, h.start, len(i.w) AS n,
         list_transform(range(1, len(i.w) + 1), lambda j: CASE WHEN h.start + j >= 1 AND d.w[h.start + j] = i.w[j]
                                                     THEN 1 ELSE 0 END) AS eq
  FROM hits h JOIN d ON d.id = h.doc_id JOIN i ON i.id = h.item_id),
scored AS (
  SELECT doc_id, item_id, start, n, list_sum(eq) AS n_equal,
         list_max(list_transform(range(1, n - least(n, {seeds.WINDOW}) + 2),
                                 lambda j: list_sum(eq[j:j + least(n, {seeds.WINDOW}) - 1]))) AS best
  FROM laid),
leak AS (
  SELECT * FROM scored
  WHERE best >= CASE WHEN n < {seeds.WHOLE} THEN n ELSE ceil({seeds.MATCH} * least(n, {seeds.WINDOW})) END),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id) AS n_places,
         row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start) AS r FROM leak)
SELECT doc_id, item_id, n_places, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n_item_words,
       CAST(n_equal AS INTEGER) AS n_equal
FROM ranked WHERE r = 1
"""

_TEMPLATES = ", ".join(
    [f"({i}, '{t}', '{label}', TRUE, 1.0)" for i, (t, label) in enumerate(lic.PHRASES)]
    + [f"({len(lic.PHRASES) + i}, '{t}', '{label}', FALSE, {least})"
       for i, (t, label, least) in enumerate(lic.NOTICES)])
_COMMON = ", ".join(f"'{w}'" for w in lic.COMMON)
ORACLES["op9_license_votes"] = rf"""
WITH raw(template, t, label, base, least) AS (VALUES {_TEMPLATES}),
tw AS (SELECT *, string_split(t, ' ') AS w FROM raw),
tg AS (
  SELECT template, label, base, least, p - 1 AS tpos, w[p] AS a, w[p + 1] AS b
  FROM tw, LATERAL (SELECT unnest(range(1, len(w))) AS p)),
tv AS (
  SELECT *, count(*) OVER (PARTITION BY template) AS n_grams FROM tg
  WHERE base OR NOT (a IN ({_COMMON}) AND b IN ({_COMMON}))),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT r, p - 1 AS pos, w[p] AS a, w[p + 1] AS b FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS p)),
v AS (SELECT g.r, g.pos, tv.*, g.pos - tv.tpos AS diag FROM g JOIN tv ON g.a = tv.a AND g.b = tv.b),
diagonal AS (
  SELECT r, template, diag, any_value(label) AS label, any_value(base) AS base, any_value(least) AS least,
         any_value(n_grams) AS n_grams, list(DISTINCT tpos) AS voters, min(pos) AS s
  FROM v GROUP BY r, template, diag),
merged AS (
  SELECT *, list(voters) OVER near AS all_voters, max(len(voters)) OVER near AS most, min(s) OVER near AS first
  FROM diagonal
  WINDOW near AS (PARTITION BY r, template ORDER BY diag RANGE BETWEEN {lic.SHIFT} PRECEDING AND {lic.SHIFT} FOLLOWING)),
span AS (
  SELECT r, label, base, least, CASE WHEN base THEN s ELSE first END AS s,
         (CASE WHEN base THEN len(voters) ELSE len(list_distinct(flatten(all_voters))) END) / n_grams AS share
  FROM merged WHERE base OR len(voters) = most),
ok AS (SELECT * FROM span WHERE share >= least)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words,
       count(CASE WHEN base THEN 1 END) AS n_base,
       CAST(min(CASE WHEN base THEN s END) AS BIGINT) AS first_word,
       CAST(max(CASE WHEN base THEN s END) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels,
       coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN ok ON d.r = ok.r GROUP BY d.r, d.doc_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES["op11_level_products"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term
         HAVING count(DISTINCT r) >= {lv.MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT d.lang, d.source, coalesce(any_value(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) d
  LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL) c USING (lang, source)
  GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS held,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
         1 + (1000000000 * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cell WHERE held > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {lv.TOP_TERMS}
"""
