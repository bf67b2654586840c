"""The same derived inputs as ``inputs.py`` written as DuckDB CTEs.

Used only by the oracle SQL of ``__spark_entry__.oracle_sql``; they restate the
seeded view independently so the Spark code is checked, not reused.
"""

from ..sources.tables import EVALUATION_DATE, SYSTEMS

WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
RTOK = ("list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), "
        "lambda w: w <> '')")


def words(x: str) -> str:
    return WORDS.format(x=x)


def rtok(x: str) -> str:
    return RTOK.format(x=x)


SEED = f"""
docs AS (
  SELECT doc_id, text, lang, source, {words('text')} AS tk,
         DATE '2023-01-01' + CAST(doc_id % 500 AS INTEGER) AS pub_date
  FROM documents),
articles AS (
  SELECT doc_id AS article_id, lang, source AS category, pub_date,
         strftime(pub_date, '%Y-%m-%d') AS date,
         array_to_string(tk[1:6], ' ') AS headline,
         array_to_string(tk, ' ') || ' The Chief Minister announced Rs '
           || CAST(doc_id % 90 + 1 AS VARCHAR) || ' crore on '
           || strftime(pub_date, '%B %-d, %Y') || '.' AS article,
         array_to_string(tk[1:55], ' ')
           || CASE WHEN doc_id % 2 = 0 THEN ' Rs crore' ELSE ' Rs million' END
           || ' on ' || strftime(CASE WHEN doc_id % 3 = 0 THEN pub_date + 400 ELSE pub_date END,
                                 '%B %-d, %Y') || '.' AS summary
  FROM docs)"""

RAW = SEED + """,
raw_articles AS (
  SELECT article_id, headline, article,
         CASE WHEN article_id % 17 = 0 THEN NULL ELSE summary END AS summary,
         CASE WHEN category = 'src3' THEN NULL ELSE category END AS category,
         date, lang
  FROM articles)"""

_SYS_VALUES = ", ".join(f"('{s}', '{m}', {o}, {n})" for s, m, o, n in SYSTEMS)

PREDS = SEED + f""",
systems(system, model_id, off, len) AS (VALUES {_SYS_VALUES}),
cand AS (
  SELECT s.system, s.model_id, s.off, s.len, a.article_id, a.article, a.summary,
         contains(lower(s.model_id), 'led') AS long_ctx,
         CASE WHEN contains(lower(s.model_id), 't5') THEN 'summarize: ' || a.article
              ELSE a.article END AS model_input,
         (s.system = 'Mini-T5' AND a.article_id % 13 = 0) AS failgen,
         a.article IS NULL OR a.article = '' OR a.summary IS NULL OR a.summary = '' AS badin
  FROM articles a CROSS JOIN systems s),
cand2 AS (SELECT *, failgen OR badin AS bad FROM cand),
preds AS (
  SELECT system, model_id, article_id, model_input, summary AS reference,
         CASE WHEN bad THEN NULL
              ELSE array_to_string(({words('article')})[off:off + len - 1], ' ') END AS generated,
         least(len({words('model_input')}), CASE WHEN long_ctx THEN 16384 ELSE 1024 END) AS input_length,
         long_ctx,
         CAST((article_id % 7) * 0.5 AS DOUBLE) AS seconds,
         CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN badin THEN 'empty article or reference'
              WHEN failgen THEN 'generation error on article ' || CAST(article_id AS VARCHAR)
                                || ': decoder produced no tokens' END AS error
  FROM cand2),
preds2 AS (
  SELECT *, CASE WHEN NOT long_ctx THEN input_length
                 WHEN input_length <= 512 THEN 512
                 ELSE (input_length // 512 + 1) * 512 END AS padded_length
  FROM preds),
toks AS (
  SELECT *, {rtok('reference')} AS rt, {rtok('generated')} AS gt FROM preds2),
grams AS (
  SELECT system, article_id, 1 AS n, 1 AS side, unnest(rt) AS g FROM toks WHERE status = 'ok'
  UNION ALL SELECT system, article_id, 1, 2, unnest(gt) FROM toks WHERE status = 'ok'
  UNION ALL SELECT system, article_id, 2, 1,
         unnest(list_transform(range(1, len(rt)), lambda i: rt[i] || ' ' || rt[i + 1]))
         FROM toks WHERE status = 'ok'
  UNION ALL SELECT system, article_id, 2, 2,
         unnest(list_transform(range(1, len(gt)), lambda i: gt[i] || ' ' || gt[i + 1]))
         FROM toks WHERE status = 'ok'),
gcount AS (
  SELECT system, article_id, n, g,
         sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS cr,
         sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS cg
  FROM grams GROUP BY system, article_id, n, g),
overlap AS (
  SELECT system, article_id,
         sum(CASE WHEN n = 1 THEN least(cr, cg) ELSE 0 END) AS o1,
         sum(CASE WHEN n = 2 THEN least(cr, cg) ELSE 0 END) AS o2
  FROM gcount GROUP BY system, article_id),
lcs AS (
  SELECT system, article_id,
    CASE WHEN len(gt) = 0 OR len(rt) = 0 THEN 0 ELSE
    list_reduce(rt, lambda p, a: list_reduce(range(1, len(gt) + 1),
        lambda c, j: list_append(c, CASE WHEN gt[j] = a THEN p[j] + 1
                                        ELSE greatest(p[j + 1], c[-1]) END),
        [0::BIGINT]),
      list_transform(range(0, len(gt) + 1), lambda x: 0::BIGINT))[-1] END AS l
  FROM toks WHERE status = 'ok'),
counts AS (
  SELECT t.system, t.article_id, t.status,
         CAST(coalesce(o.o1, 0) AS DOUBLE) AS o1, CAST(coalesce(o.o2, 0) AS DOUBLE) AS o2,
         CAST(coalesce(l.l, 0) AS DOUBLE) AS ol,
         len(t.rt) AS nr1, len(t.gt) AS ng1,
         greatest(len(t.rt) - 1, 0) AS nr2, greatest(len(t.gt) - 1, 0) AS ng2
  FROM toks t
  LEFT JOIN overlap o USING (system, article_id)
  LEFT JOIN lcs l USING (system, article_id)),
prf AS (
  SELECT system, article_id, status,
         o1 / greatest(ng1, 1) AS p1, o1 / greatest(nr1, 1) AS r1,
         o2 / greatest(ng2, 1) AS p2, o2 / greatest(nr2, 1) AS r2,
         ol / greatest(ng1, 1) AS pl, ol / greatest(nr1, 1) AS rl
  FROM counts),
scores AS (
  SELECT p.system, p.article_id, p.status,
         CASE WHEN p.status <> 'ok' THEN NULL WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS rouge1,
         CASE WHEN p.status <> 'ok' THEN NULL WHEN p2 + r2 > 0 THEN 2 * p2 * r2 / (p2 + r2) ELSE 0.0 END AS rouge2,
         CASE WHEN p.status <> 'ok' THEN NULL WHEN pl + rl > 0 THEN 2 * pl * rl / (pl + rl) ELSE 0.0 END AS rougeL,
         CASE WHEN p.status = 'ok' THEN p1 END AS rouge1_p, CASE WHEN p.status = 'ok' THEN r1 END AS rouge1_r,
         CASE WHEN p.status = 'ok' THEN p2 END AS rouge2_p, CASE WHEN p.status = 'ok' THEN r2 END AS rouge2_r,
         CASE WHEN p.status = 'ok' THEN pl END AS rougeL_p, CASE WHEN p.status = 'ok' THEN rl END AS rougeL_r,
         x.model_id, x.input_length, x.padded_length, x.seconds, x.model_input, x.reference, x.generated
  FROM prf p JOIN preds2 x USING (system, article_id)),
aggregates AS (
  SELECT system AS model_name, max(model_id) AS model_id, '{EVALUATION_DATE}' AS evaluation_date,
         count(*) AS total_samples,
         count(*) FILTER (WHERE status = 'ok') AS successful_samples,
         count(*) - count(*) FILTER (WHERE status = 'ok') AS failed_samples,
         round(count(*) FILTER (WHERE status = 'ok') / count(*) * 100, 2) AS success_rate,
         round(avg(rouge1) * 100, 2) AS rouge1_mean,
         round(avg(rouge2) * 100, 2) AS rouge2_mean,
         round(avg(rougeL) * 100, 2) AS rougeL_mean,
         round(stddev_pop(rouge1) * 100, 2) AS rouge1_std,
         round(stddev_pop(rouge2) * 100, 2) AS rouge2_std,
         round(stddev_pop(rougeL) * 100, 2) AS rougeL_std,
         round(sum(seconds), 2) AS evaluation_time_seconds,
         CASE WHEN count(*) FILTER (WHERE status = 'ok') > 0
              THEN round(sum(seconds) / count(*) FILTER (WHERE status = 'ok'), 2) ELSE 0.0 END AS time_per_sample,
         round(coalesce(avg(input_length) FILTER (WHERE status = 'ok'), 0), 0) AS avg_input_length,
         round(coalesce(avg(padded_length) FILTER (WHERE status = 'ok'), 0), 0) AS avg_padded_length,
         round(CASE WHEN avg(input_length) FILTER (WHERE status = 'ok') > 0
                    THEN (avg(padded_length) FILTER (WHERE status = 'ok') - avg(input_length) FILTER (WHERE status = 'ok'))
                         / avg(input_length) FILTER (WHERE status = 'ok') * 100 ELSE 0.0 END, 1) AS padding_overhead_percent
  FROM scores GROUP BY system),
board AS (
  SELECT model_name AS "Model", rouge1_mean AS "ROUGE-1", rouge2_mean AS "ROUGE-2",
         rougeL_mean AS "ROUGE-L", rouge1_std AS "ROUGE-1 Std", rouge2_std AS "ROUGE-2 Std",
         rougeL_std AS "ROUGE-L Std", total_samples AS "Total Samples",
         successful_samples AS "Successful", failed_samples AS "Failed",
         success_rate AS "Success Rate", round(evaluation_time_seconds / 3600, 2) AS "Time Hours"
  FROM aggregates),
ranked AS (
  SELECT row_number() OVER (ORDER BY "ROUGE-2" DESC NULLS LAST, "Model") AS "Rank", *
  FROM board)"""


def with_(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"
