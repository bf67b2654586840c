"""Loss analytics (E9-E16): lexicon preservation, hallucinated dates,
semantic fidelity, stage weighting, the step-sampled loss log and its epoch
means.  Training itself is not built; the losses are computed over tables of
(source, generated) text and per-step cross-entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_mentions
from ..functions.lexicon import (LEXICON_ROWS, SCAN_TERMS, lexicon_terms, terms_automaton,
                                 terms_substring, terms_word)
from ..functions.text import col_, rouge_tokens
from .factuality import tf_cosine

# Stage weights (ce, entity, temporal, semantic).
STAGE_WEIGHTS = {
    "warmup": {"ce": 1.0, "entity": 0.0, "temporal": 0.0, "semantic": 0.0},
    "factuality": {"ce": 0.5, "entity": 0.3, "temporal": 0.2, "semantic": 0.0},
    "refinement": {"ce": 0.4, "entity": 0.2, "temporal": 0.2, "semantic": 0.2},
}
STAGES = list(STAGE_WEIGHTS)
SAMPLE_EVERY = 10
SOURCE_CHARS, SUMMARY_CHARS = 2000, 1000


def stage_weights_df(spark: SparkSession) -> DataFrame:
    rows = [(s, w["ce"], w["entity"], w["temporal"], w["semantic"]) for s, w in STAGE_WEIGHTS.items()]
    return spark.createDataFrame(rows, "stage string, w_ce double, w_entity double, "
                                       "w_temporal double, w_semantic double")


# E9 -------------------------------------------------------------------------
def with_terms(df: DataFrame, cols: dict[str, str], match: str = "substring", lexicon=None) -> DataFrame:
    """Lexicon terms found in each text (a set).  ``substring`` reproduces the
    reference (substring of the lower-cased text); ``word`` needs whole words.

    ``lexicon`` is a list of terms or a table with a ``term`` column, of up to
    ``LEXICON_BYTES``, in place of the fixed one.  One of more than ``SCAN_TERMS`` terms is
    looked for by an automaton, whose pass over a text does not depend on their number."""
    out = df
    if lexicon is not None:
        return _with_lexicon(out, cols, match, lexicon_terms(lexicon))
    for src, dst in cols.items():
        tmp = f"_{dst}_src"
        if match == "substring":
            out = out.withColumn(tmp, F.lower(F.col(src))).withColumn(dst, terms_substring(tmp))
        elif match == "word":
            out = out.withColumn(tmp, rouge_tokens(src)).withColumn(dst, terms_word(tmp))
        else:
            raise ValueError(match)
        out = out.drop(tmp)
    return out


def _with_lexicon(df: DataFrame, cols: dict[str, str], match: str, terms: list[str]) -> DataFrame:
    if match not in ("substring", "word"):
        raise ValueError(match)
    word = match == "word"
    for src, dst in cols.items():
        # words between single spaces, so that a whole word is a substring with its spaces
        text = (F.concat(F.lit(" "), F.array_join(rouge_tokens(src), " "), F.lit(" ")) if word
                else F.lower(F.col(src)))
        sought = [f" {t} " for t in terms] if word else terms
        if len(sought) > SCAN_TERMS:
            found = terms_automaton(df.sparkSession, text, sought)
            df = df.withColumn(dst, F.transform(found, lambda x: F.trim(x)) if word else found)
        else:
            tmp = f"_{dst}_src"
            listed = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in zip(sought, terms)])
            hits = F.transform(F.filter(listed, lambda x: F.col(tmp).contains(x["s"])), lambda x: x["t"])
            df = df.withColumn(tmp, text)
            nothing = F.array().cast("array<string>")
            df = df.withColumn(dst, F.when(F.col(tmp).isNull(), nothing).otherwise(hits) if terms else nothing).drop(tmp)
    return df


# E10 / E12 ------------------------------------------------------------------
def lexicon_loss(source_terms, summary_terms) -> Column:
    """1 - preserved/source terms; no source terms -> 0.0."""
    s, m = col_(source_terms), col_(summary_terms)
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.size(F.array_intersect(s, m)) / F.size(s))


def hallucination_loss(summary_dates, source_dates) -> Column:
    """Share of summary dates absent from the source; none -> 0.0."""
    s, src = col_(summary_dates), col_(source_dates)
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.array_except(s, src)) / F.size(s))


def with_hallucinated_dates(df: DataFrame, summary: str, source: str, patterns: str = "strict") -> DataFrame:
    d = df.withColumns({"_sd": date_mentions(summary, patterns), "_rd": date_mentions(source, patterns)})
    return d.withColumns({
        "hallucinated_dates": F.array_sort(F.array_except("_sd", "_rd")),
        "temporal_loss": hallucination_loss("_sd", "_rd")}).drop("_sd", "_rd")


# E13 ------------------------------------------------------------------------
def semantic_loss(source, summary) -> Column:
    """1 - cosine(source[:2000], summary[:1000]) on term-frequency vectors; 0.0
    where a text is missing or empty (nothing to compare is no loss)."""
    nothing = (F.coalesce(F.trim(col_(source)), F.lit("")) == "") | \
        (F.coalesce(F.trim(col_(summary)), F.lit("")) == "")
    return F.when(nothing, F.lit(0.0)).otherwise(
        F.lit(1.0) - tf_cosine(source, summary, SOURCE_CHARS, SUMMARY_CHARS))


# E11 ------------------------------------------------------------------------
def drop_report(df: DataFrame, source_terms: str, summary_terms: str, lexicon: DataFrame) -> DataFrame:
    """Per (category, term): source occurrences, preserved, dropped, rate.

    Only rows that carry terms are exploded; the lexicon joins by term
    and the counts combine map-side, so a term present in every article is
    one row per map partition before the shuffle.
    """
    # explode_outer + filter keeps the optimizer from pushing an inferred
    # size(terms) > 0 predicate (and the term matching) below this projection
    ex = (df.select(F.explode_outer(source_terms).alias("term"),
                    F.col(summary_terms).alias("_sum"))
            .filter(F.col("term").isNotNull()))
    ex = ex.withColumn("kept", F.array_contains("_sum", F.col("term")))
    j = ex.join(lexicon, "term")
    return (j.groupBy("category", "term").agg(
                F.count(F.lit(1)).alias("in_source"),
                F.count_if("kept").alias("preserved"))
             .withColumn("dropped", F.col("in_source") - F.col("preserved"))
             .withColumn("drop_rate", F.col("dropped") / F.col("in_source")))


def most_dropped(report: DataFrame, k: int = 10) -> DataFrame:
    return report.orderBy(F.desc("dropped"), F.asc("term"), F.asc("category")).limit(k)


# E14 ------------------------------------------------------------------------
def component_losses(df: DataFrame, source: str, generated: str,
                     parts=("entity", "temporal", "semantic")) -> DataFrame:
    """entity / temporal / semantic loss columns for (source, generated)."""
    d = df
    if "entity" in parts:
        d = with_terms(d, {source: "_st", generated: "_gt"}).withColumn(
            "entity_loss", lexicon_loss("_st", "_gt")).drop("_st", "_gt")
    if "temporal" in parts:
        d = d.withColumns({"_sd": date_mentions(generated, "strict"),
                           "_rd": date_mentions(source, "strict")})
        d = d.withColumn("temporal_loss", hallucination_loss("_sd", "_rd")).drop("_sd", "_rd")
    if "semantic" in parts:
        d = d.withColumn("semantic_loss", semantic_loss(source, generated))
    return d


def weighted_total(ce, weights_prefix: str = "w_") -> Column:
    return (F.col(f"{weights_prefix}ce") * col_(ce) +
            F.col(f"{weights_prefix}entity") * F.col("entity_loss") +
            F.col(f"{weights_prefix}temporal") * F.col("temporal_loss") +
            F.col(f"{weights_prefix}semantic") * F.col("semantic_loss"))


def stage_what_if(losses: DataFrame, weights: DataFrame, ce: str = "ce") -> DataFrame:
    """Total loss of each row under every stage (3-row broadcast cross join)."""
    j = losses.crossJoin(F.broadcast(weights))
    return j.withColumn("total", weighted_total(ce))


# E15 / E16 ------------------------------------------------------------------
def step_log(steps: DataFrame, weights: DataFrame, source: str = "source",
             generated: str = "generated") -> DataFrame:
    """Per-step record (ce, entity, temporal, semantic, total).

    Losses are computed on every 10th batch outside warm-up; other steps
    record zeros and total = unweighted ce (reference behaviour).  Texts of
    unsampled steps are nulled *before* scoring so the expensive parts run
    only on sampled rows, without a join back.
    """
    sampled = (F.col("batch_idx") % SAMPLE_EVERY == 0) & (F.col("stage") != "warmup")
    d = steps.withColumn("sampled", sampled)
    d = d.withColumns({"_src": F.when(F.col("sampled"), F.col(source)),
                       "_gen": F.when(F.col("sampled"), F.col(generated))})
    d = component_losses(d, "_src", "_gen").join(F.broadcast(weights), "stage", "left")
    zero = F.lit(0.0)
    parts = {p: F.when(F.col("sampled"), F.col(f"{p}_loss")).otherwise(zero)
             for p in ("entity", "temporal", "semantic")}
    total = F.when(F.col("sampled"), weighted_total("ce")).otherwise(F.col("ce"))
    return d.select("stage", "epoch", "batch_idx", "sampled", F.col("ce").cast("double").alias("ce"),
                    *[c.alias(p) for p, c in parts.items()], total.alias("total"))


def epoch_means(log: DataFrame) -> DataFrame:
    """Mean of each part per (stage, epoch) over all steps (reference: the
    zeros of unsampled steps included) and over sampled steps only."""
    cols = ["ce", "entity", "temporal", "semantic", "total"]
    aggs = [F.count(F.lit(1)).alias("steps"), F.count_if("sampled").alias("sampled_steps")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in cols]
    aggs += [F.avg(F.when(F.col("sampled"), F.col(c))).alias(f"{c}_mean_sampled") for c in cols]
    return log.groupBy("stage", "epoch").agg(*aggs)


def lexicon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, "category string, term string")
