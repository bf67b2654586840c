"""Factuality scoring of (summary, source) pairs.

Every score is a row-local expression over arrays extracted from the two
texts, so pairs never shuffle.  The only grouped steps are the per-system
aggregates (partial + final aggregation, one row per system).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import materialize, staged
from ..functions.dates import date_match_parts, date_mentions, mentions_from_parts
from ..functions.kernels import gazetteer_udf, tf_cosine_udf, token_counts_udf
from ..functions.lexicon import ENTITY_TOKEN, GAZETTEER
from ..functions.text import all_ngrams, col_, rouge_tokens, truncate_chars

# Composite weights (must sum to 1) and the similarity threshold.
FACTUALITY_WEIGHTS = {"entity": 0.40, "temporal": 0.30, "semantic": 0.30}
SEMANTIC_THRESHOLD = 0.5

assert abs(sum(FACTUALITY_WEIGHTS.values()) - 1.0) < 1e-3


# E3 / E4 --------------------------------------------------------------------
def temporal_consistency(summary_dates, source_dates) -> Column:
    """Share of summary dates found in the source; no summary dates -> 1.0."""
    s, src = col_(summary_dates), col_(source_dates)
    return F.when(F.size(s) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(s, src)) / F.size(s))


def with_dates(df: DataFrame, cols: dict[str, str], patterns: str = "loose",
               mode: str = "reference") -> DataFrame:
    """``cols`` maps text column -> output date-set column."""
    return df.withColumns({out: date_mentions(src, patterns, mode) for src, out in cols.items()})


# E1 -------------------------------------------------------------------------
def _entity_struct(t, x) -> Column:
    return F.struct(t.alias("ent_type"), x.alias("ent_text"))


def _empty_entities() -> Column:
    return F.array().cast("array<struct<ent_type:string,ent_text:string>>")


def with_entities(df: DataFrame, text: str, out: str, gazetteer=None,
                  distinct: bool = False, date_parts: str | None = None) -> DataFrame:
    """Typed entity mentions ``array<struct<ent_type, ent_text>>`` of ``text``.

    Mentions are word n-grams (original case) whose lower-case form is a
    gazetteer term, by n and position, once for every type of the term, plus
    DATE mentions from the loose date patterns.  ``gazetteer`` is a list of
    (type, term), which travels with a row-local Arrow kernel, or a DataFrame
    ``(ent_type, term)`` of any size, whose terms are joined to the n-grams.
    Both give the same mentions.
    ``distinct=True`` returns each (type, text) mention once.  ``date_parts``
    names a materialised ``date_match_parts`` column to reuse.
    """
    rows = gazetteer if gazetteer is not None else GAZETTEER
    if isinstance(rows, DataFrame):
        df, named = _joined_mentions(df, text, rows, distinct)
    else:
        terms: dict[str, list[str]] = {}
        for t, term in sorted(set(rows)):
            types = terms.setdefault(" ".join(term.lower().split()), [])
            if t not in types:
                types.append(t)
        longest = max((len(t.split()) for t in terms), default=0)
        named = gazetteer_udf(terms, longest, ENTITY_TOKEN, distinct)(F.col(text))
    found = (mentions_from_parts(date_parts, "loose", "full", distinct) if date_parts
             else date_mentions(F.col(text), "loose", "full", distinct=distinct))
    dates = F.transform(found, lambda x: _entity_struct(F.lit("DATE"), x))
    return df.withColumn(out, F.concat(named, dates)).drop("_named", "_text_hash")


def _joined_mentions(df: DataFrame, text: str, gaz: DataFrame, distinct: bool):
    """``df`` with the mentions of each text, and that column.  Mentions depend on
    the text alone, so they are grouped and joined back by its hash; texts that are
    equal share them, and no key column is needed."""
    term = F.lower(F.array_join(F.filter(F.split("term", r"\s+"), lambda w: w != ""), " "))
    g = gaz.select(term.alias("_term"), "ent_type").distinct()
    longest = g.agg(F.max(F.size(F.split("_term", " ")))).first()[0] or 1
    keyed = df.withColumn("_text_hash", F.sha2(F.col(text), 256))
    toks = materialize(keyed.select("_text_hash", F.regexp_extract_all(
        F.col(text), F.lit(ENTITY_TOKEN), F.lit(0)).alias("_t")))
    grams = (toks.select("_text_hash", F.posexplode_outer(all_ngrams("_t", longest)).alias("_pos", "_g"))
                 .filter(F.col("_g").isNotNull()))
    hits = grams.join(g, F.lower(grams["_g"]) == g["_term"])
    ents = hits.groupBy("_text_hash").agg(F.transform(
        F.array_sort(F.collect_set(F.struct("_pos", "ent_type", "_g"))),
        lambda s: _entity_struct(s["ent_type"], s["_g"])).alias("_named"))
    named = F.when(F.col(text).isNotNull(), F.coalesce("_named", _empty_entities()))
    return keyed.join(ents, "_text_hash", "left"), F.array_distinct(named) if distinct else named


_APART = "\u0000"


# E2 -------------------------------------------------------------------------
def entity_consistency(summary_ents: str, source_ents: str) -> Column:
    """Per summary mention: 1 if the exact text is a source mention of the same
    type, else 0.5 if its lower case is a substring of one, else 0; the sum
    over mentions / count, capped at 1; no summary mentions -> 1.0.
    Both arguments name materialised columns.

    The source mentions are indexed once a pair: by type, their lower-case texts joined by
    a sign that no mention holds.  A summary mention is then one search in one string, and
    not a lambda over all source mentions."""
    src, se = F.col(source_ents), F.col(summary_ents)

    def joined(kind):
        texts = F.transform(F.filter(src, lambda s: s["ent_type"] == kind), lambda s: F.lower(s["ent_text"]))
        return F.struct(kind.alias("k"), F.array_join(F.array_distinct(texts), _APART).alias("v"))

    kinds = F.array_distinct(F.transform(src, lambda s: s["ent_type"]))
    index = F.map_from_entries(F.transform(kinds, joined))

    def score(e, known):
        part = F.try_element_at(known["by_type"], e["ent_type"]).contains(F.lower(e["ent_text"]))
        return F.when(F.array_contains(known["all"], e), F.lit(1.0)).when(part, F.lit(0.5)).otherwise(F.lit(0.0))

    # a lambda variable is evaluated once, so the index is not built again for each mention
    each = F.transform(F.array(F.struct(index.alias("by_type"), src.alias("all"))), lambda known: F.aggregate(
        se, F.lit(0.0), lambda acc, e: acc + score(e, known)))
    matched = each[0]
    return F.when(F.size(se) == 0, F.lit(1.0)).otherwise(F.least(matched / F.size(se), F.lit(1.0)))


# E5 / E6 --------------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0), lambda acc, x: acc + x * x))


def dense_cosine(a: str, b: str) -> Column:
    """Cosine of two dense vectors (double arithmetic); 0 for a zero norm, null
    for a missing vector.  Arguments name materialised ``array<double>`` columns."""
    den = norm(a) * norm(b)
    return (F.when(col_(a).isNull() | col_(b).isNull(), F.lit(None).cast("double"))
             .when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0)))


def tf_cosine(a_text, b_text, a_chars: int | None = None, b_chars: int | None = None) -> Column:
    """Cosine of term-frequency vectors of the ROUGE tokens of two texts."""
    a, b = col_(a_text), col_(b_text)
    if a_chars:
        a = truncate_chars(a, a_chars)
    if b_chars:
        b = truncate_chars(b, b_chars)
    return tf_cosine_udf(rouge_tokens(a), rouge_tokens(b))


#: Tokens of the idf table that are looked up apart from the others, by document frequency.
FREQUENT_TOKENS = 100_000


def row_terms(pairs: DataFrame, key: str, a_text: str, b_text: str) -> DataFrame:
    """``(key, terms)``: the distinct tokens of each row's two texts, with how often each
    stands in them."""
    def tokens(text):
        return rouge_tokens(F.coalesce(col_(text), F.lit("")))

    return pairs.select(key, token_counts_udf(tokens(a_text), tokens(b_text)).alias("terms"))


def counts_of_rows(rows: DataFrame, key: str, repeated: bool = True) -> DataFrame:
    """``term_counts`` from ``row_terms``.  The rows of a key stand apart, so only the counts
    of keys that are ``repeated`` are added up by a shuffle."""
    if not repeated:
        each = rows.select(key, F.explode_outer("terms").alias("_t"))
        return each.select(key, "_t.tok", *[F.coalesce(F.col(f"_t.{c}").cast("long"), F.lit(0)).alias(c) for c in ("ta", "tb")])
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_k"))
    same = rows[key].eqNullSafe(F.col("_k"))
    once = counts_of_rows(rows.join(many, same, "left_anti"), key, False)
    again = counts_of_rows(rows.join(many, same, "left_semi"), key, False)
    return once.unionByName(again.groupBy(key, "tok").agg(F.sum("ta").alias("ta"), F.sum("tb").alias("tb")))


def term_counts(pairs: DataFrame, key: str, a_text: str, b_text: str) -> DataFrame:
    """``(key, tok, ta, tb)``: how often each token stands in the two texts of a
    pair.  A pair without tokens keeps one row with a null token."""
    return counts_of_rows(row_terms(pairs, key, a_text, b_text), key)


def idf_table(counts: DataFrame, n_docs: int) -> DataFrame:
    """``(tok, idf)`` over the second texts of ``term_counts``: smooth
    idf = ln((1 + N) / (1 + df)) + 1.  Counts combine map-side, so a token
    present in every document is one row per map partition."""
    df = (counts.filter(F.col("tok").isNotNull()).groupBy("tok")
                .agg(F.count_if(F.col("tb") > 0).alias("df")))
    return (df.filter(F.col("df") > 0)
              .select("tok", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")))


def tfidf_cosine(pairs: DataFrame, key: str, a_text: str, b_text: str,
                 frequent: int = FREQUENT_TOKENS) -> DataFrame:
    """``(key, tfidf_cosine)`` of the two texts of each pair, with the idf of the
    second texts (0 when a side has no tokens of the corpus).

    The pairs are read and tokenised once: the tokens of each row are counted in place and
    staged, a row for a pair, and both the idf table and the sums come from them.  The idf
    table is staged in two parts.  That of about ``frequent`` tokens of least idf holds nearly
    all occurrences; below the session's threshold it is broadcast, so their sums are made in
    place and a pair leaves as one row.  Only the occurrences of the other tokens are dealt by
    token.  Where a table is not broadcast, the join is one of two plain exchanges, in which a
    token of very many pairs is split.
    """
    rows = staged(row_terms(pairs, key, a_text, b_text), "row-terms")
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n, most = per_key.agg(F.count(key), F.max("_n")).first()
    counts = counts_of_rows(rows, key, (most or 0) > 1)
    if (most or 0) > 1:
        counts = staged(counts, "term-counts")
    idf = staged(idf_table(counts, n), "idf")
    parts, known = [idf], idf.count()
    if known > frequent:
        # the lightest tokens; those of one idf stay together
        bound = idf.agg(F.percentile_approx("idf", frequent / known, 10_000)).first()[0]
        parts = [staged(idf.where(keep), name) for keep, name in (
            (F.col("idf") < bound, "idf-frequent"), (F.col("idf") >= bound, "idf-others"))]

    def sums(of: DataFrame, table: DataFrame) -> DataFrame:
        x = F.col("idf")
        return of.join(table, "tok").groupBy(key).agg(
            F.sum(F.col("ta") * F.col("tb") * x * x).alias("_dot"),
            F.sum(F.pow(F.col("ta") * x, 2)).alias("_na"),
            F.sum(F.pow(F.col("tb") * x, 2)).alias("_nb"))

    # tokens that no second text has weigh nothing, but every key keeps its row
    none = F.lit(None).cast("double")
    added = rows.select(key, none.alias("_dot"), none.alias("_na"), none.alias("_nb")).unionByName(
        sums(counts, parts[0]))
    if len(parts) > 1:
        others = counts.where(F.col("tok").isNotNull()).join(parts[0], "tok", "left_anti")
        added = added.unionByName(sums(others, parts[1]))
    added = added.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("_dot", "_na", "_nb")])
    cos = F.when((F.coalesce("_na", F.lit(0.0)) > 0) & (F.coalesce("_nb", F.lit(0.0)) > 0),
                 F.col("_dot") / (F.sqrt("_na") * F.sqrt("_nb"))).otherwise(F.lit(0.0))
    return added.select(key, cos.alias("tfidf_cosine"))


# E7 / E8 --------------------------------------------------------------------
SOURCE_FEATURES = ("_src_ents", "_src_dates", "_src_tok")


def with_source_features(df: DataFrame, source: str = "source", gazetteer=None) -> DataFrame:
    """Source-side inputs of the factuality scores: distinct typed mentions,
    the loose date set and the ROUGE tokens.  Compute them once per source
    document -- before fanning a document out to many candidate summaries."""
    d = materialize(df.withColumn("_src_dparts", date_match_parts(source, "loose")))
    d = with_entities(d, source, "_src_ents_all", gazetteer, distinct=True, date_parts="_src_dparts")
    return d.withColumns({
        "_src_ents": F.array_distinct("_src_ents_all"),
        "_src_dates": mentions_from_parts("_src_dparts", "loose"),
        "_src_tok": rouge_tokens(source)}).drop("_src_ents_all", "_src_dparts")


def factuality_scores(pairs: DataFrame, summary: str = "summary", source: str = "source",
                      gazetteer=None, weights: dict[str, float] = FACTUALITY_WEIGHTS) -> DataFrame:
    """Adds entity, temporal, semantic, overall (each rounded to 3, overall
    from the unrounded parts) and the ``semantic_ok`` threshold flag.  Source
    features already present (``with_source_features``) are reused."""
    d = pairs if all(c in pairs.columns for c in SOURCE_FEATURES) \
        else with_source_features(pairs, source, gazetteer)
    d = materialize(d.withColumn("_sum_dparts", date_match_parts(summary, "loose")))
    d = with_entities(d, summary, "_sum_ents", gazetteer, date_parts="_sum_dparts")
    d = d.withColumn("_sum_dates", mentions_from_parts("_sum_dparts", "loose")).drop("_sum_dparts")
    # the scores below read the mention arrays inside lambdas; materialise
    # them so they are not re-derived per element
    d = materialize(d)
    d = d.withColumns({
        "_entity": entity_consistency("_sum_ents", "_src_ents"),
        "_temporal": temporal_consistency("_sum_dates", "_src_dates"),
        "_semantic": tf_cosine_udf(rouge_tokens(summary), F.col("_src_tok"))})
    overall = (F.lit(weights["entity"]) * F.col("_entity") +
               F.lit(weights["temporal"]) * F.col("_temporal") +
               F.lit(weights["semantic"]) * F.col("_semantic"))
    d = d.withColumns({
        "entity": F.round("_entity", 3), "temporal": F.round("_temporal", 3),
        "semantic": F.round("_semantic", 3), "overall": F.round(overall, 3),
        "n_summary_entities": F.size("_sum_ents"), "n_summary_dates": F.size("_sum_dates")})
    d = d.withColumn("semantic_ok", F.col("_semantic") >= SEMANTIC_THRESHOLD)
    return d.drop("_sum_ents", "_sum_dates", "_entity", "_temporal", "_semantic", *SOURCE_FEATURES)


def semantic_ok(summary: str, source: str) -> Column:
    """E8 alone: the similarity reaches the threshold (no entity or date work)."""
    return tf_cosine(summary, source) >= SEMANTIC_THRESHOLD


# E17 / E18 ------------------------------------------------------------------
def system_factuality(scored: DataFrame, by: str = "system") -> DataFrame:
    """Means per system, with the number of rows where each check applied."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("entity").alias("entity"), F.avg("temporal").alias("temporal"),
        F.avg("semantic").alias("semantic"), F.avg("overall").alias("overall"),
        F.count_if(F.col("n_summary_entities") > 0).alias("entity_applicable"),
        F.count_if(F.col("n_summary_dates") > 0).alias("temporal_applicable"))


def masked_errors(scored: DataFrame, by: str = "system") -> DataFrame:
    """Pairs that look similar (semantic >= threshold) but fail the entity or
    temporal check: count and rate per system."""
    flag = F.col("semantic_ok") & ((F.col("entity") < 1.0) | (F.col("temporal") < 1.0))
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("semantic_ok")).alias("similar"),
        F.count_if(flag).alias("masked_errors")) \
        .withColumn("masked_rate", F.when(F.col("similar") > 0, F.col("masked_errors") / F.col("similar"))
                    .otherwise(F.lit(0.0)))
