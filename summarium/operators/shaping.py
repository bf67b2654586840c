"""Input shaping: multi-document assembly, prefixes, lengths, padding,
sequence encoding and the extractive candidate generator (I1-I10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_, ngrams, preview, truncate_chars, words

# Fixed values of the evaluation setup.
DOC_SEPARATOR = "\n\n[DOCUMENT]\n\n"
MAX_DOCS_PER_EVENT = 5
T5_PREFIX = "summarize: "
MAX_INPUT_TOKENS = 1024
MAX_INPUT_TOKENS_LONG = 16384
ATTENTION_WINDOW = 512
MIN_SUMMARY_WORDS = 40
MAX_SUMMARY_WORDS = 150
PAD_ID, UNK_ID, LABEL_IGNORE = 0, 1, -100


# I1 -------------------------------------------------------------------------
def multidoc_inputs(df: DataFrame, event: str, order_cols: list[str],
                    text: str, max_docs: int = MAX_DOCS_PER_EVENT,
                    sep: str = DOC_SEPARATOR) -> DataFrame:
    """Concatenate the first ``max_docs`` documents of each event in order.

    The cap is taken before nulls are dropped (as configured).  Documents are
    ranked with a window and cut *before* grouping, so ``collect_list`` only
    ever sees ``max_docs`` rows per event, however large the event is.
    """
    w = Window.partitionBy(event).orderBy(*order_cols)
    first = (df.select(event, *order_cols, text)
               .withColumn("_rk", F.row_number().over(w))
               .filter(F.col("_rk") <= max_docs))
    agg = first.groupBy(event).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rk"), F.col(text).alias("t"))))
         .alias("_docs"),
        F.count(F.lit(1)).alias("n_docs"))
    texts = F.transform(F.filter("_docs", lambda d: d["t"].isNotNull()),
                        lambda d: d["t"])
    return agg.select(event, "n_docs",
                      F.size(texts).alias("n_used"),
                      F.array_join(texts, sep).alias("input_text"))


# I2 / I3 --------------------------------------------------------------------
def is_t5_family(model_id) -> Column:
    return F.lower(col_(model_id)).contains("t5")


def is_long_context(model_id) -> Column:
    return F.lower(col_(model_id)).contains("led")


def with_task_prefix(text, model_id) -> Column:
    return F.when(is_t5_family(model_id), F.concat(F.lit(T5_PREFIX), col_(text))) \
            .otherwise(col_(text))


# I6 / I7 --------------------------------------------------------------------
def token_length(text, long_context: Column, n_words: Column | None = None) -> Column:
    """Token count after truncation (token = whitespace word).  ``n_words``
    may pass a count already known for ``text``."""
    n = F.size(words(text)) if n_words is None else n_words
    cap = F.when(long_context, F.lit(MAX_INPUT_TOKENS_LONG)).otherwise(F.lit(MAX_INPUT_TOKENS))
    return F.least(n, cap)


def padded_length(n, long_context: Column, window: int = ATTENTION_WINDOW) -> Column:
    """Pad to the attention block: <=w -> w, else (n div w + 1) * w (exact
    multiples go one block further, as the reference does)."""
    n = col_(n)
    blocks = F.when(n <= window, F.lit(window)).otherwise(
        (F.floor(n / window).cast("int") + 1) * window)
    return F.when(long_context, blocks).otherwise(n)


# I8 -------------------------------------------------------------------------
def build_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """token -> id by (count desc, token) over whole texts; 0 = pad, 1 = unk.

    Distributed: explode, partial count per partition, final count per token,
    then ids by a range-partitioned sort of the vocabulary table only.
    """
    # explode_outer + explicit filter: a plain explode makes the optimizer
    # infer size(tokens) > 0 and push it below the projection, re-running
    # the tokenizer inside that predicate.
    counts = (df.select(F.explode_outer(words(text)).alias("token"))
                .filter(F.col("token").isNotNull())
                .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    # ids follow a total order of the vocabulary; positions are assigned with
    # a range-partitioned sort, not a single-partition window
    from .corpus import global_positions
    ranked = global_positions(counts, [F.col("freq").desc(), F.col("token").asc()],
                              ["token", "freq"], "_pos")
    return ranked.select("token", "freq", (F.col("_pos") + UNK_ID).cast("int").alias("token_id"))


def token_ids(df: DataFrame, key: str, sides: list[tuple[str, int, int | None]],
              vocab: DataFrame) -> DataFrame:
    """(key, ids_0, ids_1, ...): the token ids of several texts of a row, each
    ``(text, max_len, max_chars)``, in one pass and one join.

    Truncation happens before the explode, so at most ``sum(max_len)`` rows per
    document enter the join; a row without words keeps one null token, so
    nothing is joined back.  The vocabulary is joined by token (Spark picks
    broadcast when its size allows; a frequent token is a skewed key that
    the adaptive sort-merge join splits).
    """
    def tagged(i, text, max_len, max_chars):
        t = truncate_chars(text, max_chars) if max_chars else col_(text)
        return F.transform(F.slice(words(F.coalesce(t, F.lit(""))), 1, max_len), lambda w, p: F.struct(
            F.lit(i).alias("side"), p.alias("pos"), w.alias("token")))

    parts = [tagged(i, *side) for i, side in enumerate(sides)]
    toks = df.select(key, F.explode_outer(F.concat(*parts)).alias("_e")).select(key, "_e.*")
    ids = toks.join(vocab.select("token", "token_id"), "token", "left").select(
        key, F.when(F.col("token").isNotNull(), F.struct(
            "side", "pos", F.coalesce("token_id", F.lit(UNK_ID)).alias("tid"))).alias("_t"))
    seq = ids.groupBy(key).agg(F.array_sort(F.collect_list("_t")).alias("_all"))

    def of(i):
        return F.transform(F.filter("_all", lambda s: s["side"] == i), lambda s: s["tid"]).alias(f"ids_{i}")

    return seq.select(key, *[of(i) for i in range(len(sides))])


def padded(ids: str, max_len: int) -> Column:
    return F.concat(F.col(ids), F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))))


def attention_mask(ids: str, max_len: int) -> Column:
    k = F.size(ids)
    return F.concat(F.array_repeat(F.lit(1), k),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - k, F.lit(0))))


def masked_labels(ids: str, max_len: int) -> Column:
    """Padded ids with the padding replaced by the ignored label."""
    return F.transform(padded(ids, max_len),
                       lambda x: F.when(x == PAD_ID, F.lit(LABEL_IGNORE)).otherwise(x))


def encode_sequences(df: DataFrame, key: str, text: str, vocab: DataFrame,
                     max_len: int, max_chars: int | None = None,
                     mask_labels: bool = False) -> DataFrame:
    """Token ids of one text padded/truncated to ``max_len`` with a mask."""
    e = token_ids(df, key, [(text, max_len, max_chars)], vocab)
    labels = [masked_labels("ids_0", max_len).alias("labels")] if mask_labels else []
    return e.select(key, padded("ids_0", max_len).alias("input_ids"),
                    attention_mask("ids_0", max_len).alias("attention_mask"), *labels)


def encode_pairs(df: DataFrame, key: str, source: str, target: str, vocab: DataFrame,
                 max_source: int = 1024, max_target: int = 128, source_chars: int | None = None,
                 mask_labels: bool = True) -> DataFrame:
    """One training row: ids and mask of the source, labels of the target."""
    e = token_ids(df, key, [(source, max_source, source_chars), (target, max_target, None)], vocab)
    labels = masked_labels("ids_1", max_target) if mask_labels else padded("ids_1", max_target)
    return e.select(key, padded("ids_0", max_source).alias("input_ids"),
                    attention_mask("ids_0", max_source).alias("attention_mask"), labels.alias("labels"))


# I9 / I10 -------------------------------------------------------------------
def extractive_candidates(docs: DataFrame, systems: DataFrame,
                          text: str = "article") -> DataFrame:
    """Stand-in generator: each system emits the word span [off, off+len).

    ``systems`` is a fixed small dimension, broadcast to every partition of
    the documents, so the cross join is a map-side expansion with no shuffle.
    The text is split once per document, before the fan-out; its word count
    is kept as ``source_words``.
    """
    with_tokens = docs.withColumn("_words", words(text))
    return (with_tokens.crossJoin(F.broadcast(systems))
                .withColumn("generated", F.array_join(F.slice("_words", F.col("off"), F.col("len")), " "))
                .withColumn("source_words", F.size("_words"))
                .drop("_words"))


def with_constraint_flags(df: DataFrame, generated: str = "generated") -> DataFrame:
    """Length within [40, 150] words and number of repeated word trigrams."""
    t = df.withColumn("_gw", words(generated)).withColumn("_tri", ngrams("_gw", 3))
    n = F.size("_gw")
    return t.withColumns({
        "gen_words": n,
        "len_ok": (n >= MIN_SUMMARY_WORDS) & (n <= MAX_SUMMARY_WORDS),
        "repeated_trigrams": F.size("_tri") - F.size(F.array_distinct("_tri")),
    }).drop("_gw", "_tri")


def constraint_rates(preds: DataFrame, generated: str = "generated",
                     by: str = "system") -> DataFrame:
    flagged = with_constraint_flags(preds, generated)
    return flagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("len_ok")).alias("n_len_ok"),
        F.count_if(F.col("repeated_trigrams") == 0).alias("n_no_repeat"),
        F.sum("repeated_trigrams").alias("repeated_trigrams"),
        F.min("gen_words").alias("min_words"),
        F.max("gen_words").alias("max_words"))


__all__ = ["multidoc_inputs", "with_task_prefix", "is_long_context", "is_t5_family",
           "token_length", "padded_length", "build_vocabulary", "encode_sequences",
           "extractive_candidates", "with_constraint_flags", "constraint_rates",
           "preview", "truncate_chars"]
