"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed row of ones and zeros; words under a zero are ignored, so a
substituted word there does not change the hash.  Every window of every benchmark
item and of every document is hashed under each mask, and equal hashes are joined.
A hit fixes a diagonal (document position minus item position); the item's words are
laid along it, and the document leaks the item where some ``WINDOW`` consecutive item
words (all, for shorter items) hold at least ``MATCH`` of equal words.  Everything is
built-in columns.

The masks lose nothing that this rule accepts: every placing of the substitutions it
allows leaves a window of some mask untouched (``tests`` enumerate them).  Items of 13
words and more have two masks, those of 8 to 12 words two shorter ones; shorter items, of
``LEAST`` words at least, must stand whole and are hashed whole.  Documents are hashed
only under masks that some item has.

Scale: the seeds of the benchmark are broadcast only below ``BROADCAST_SEEDS`` rows
(24 bytes each); a larger benchmark is joined by shuffle.  Documents are read twice
and never shuffled by the broadcast way: hits, a small staged table, are joined back
to the scan to verify them.

Defined cases: words are lower-cased runs of letters and digits of any script; null
and empty texts hold none; items of fewer than ``LEAST`` words are no passage and are not
looked for (``short_items`` lists them); texts of any length are hashed whole; a text and
an item of one repeated word meet at every pair of places before these become diagonals;
a null id is an id of its own; repeated rows are found once per (id, text); an empty
table or benchmark gives an empty result; extra columns stay (``decontaminate``) or are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import materialize
from .common import row_key, staged, text_or_empty

#: Items of fewer words must stand whole; of fewer than ``LEAST`` they are no passage.
WHOLE, LEAST = 8, 4
WINDOW, MATCH = 13, 0.8
#: (mask, fewest and most words of its items).
MASKS = ([("11101011", WINDOW, None), ("11001111", WINDOW, None),
          ("101011", WHOLE, WINDOW - 1), ("100111", WHOLE, WINDOW - 1)]
         + [("1" * n, n, n) for n in range(LEAST, WHOLE)])
#: Rows of benchmark seeds up to which they are broadcast (about 100 MB).
BROADCAST_SEEDS = 4_000_000
SEPARATORS = r"[^\p{L}\p{N}]+"


def words_of(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(text_or_empty(text)), SEPARATORS), "")


def _masks_of(items: DataFrame) -> list[int]:
    """The masks that the lengths of the items (word array ``w``) ask for."""
    kinds = items.select(F.least(F.size("w"), F.lit(WINDOW)).alias("n")).distinct()
    lengths = [r.n for r in kinds.collect()]  # at most ``WINDOW`` rows
    return [m for m, (_, least, most) in enumerate(MASKS)
            if any(n >= least and (most is None or n <= most) for n in lengths)]


def _seeds(words: str, masks: list[int], items: bool) -> Column:
    """Hashes of all windows, mask after mask, as many as words for each: null where the
    window would pass the end and, for items, where the mask is not theirs."""
    n = F.size(words)

    def under(m: int) -> Column:
        mask, least, most = MASKS[m]
        kept = [j for j, bit in enumerate(mask) if bit == "1"]
        fits = F.lit(True)
        if items:
            fits = n >= least if most is None else n.between(least, most)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(
            fits & (i + len(mask) <= n),
            F.xxhash64(F.lit(m), *[F.get(F.col(words), i + j) for j in kept])))

    return F.when(n >= LEAST, F.concat(*[under(m) for m in masks]))


def _windows(tokens: DataFrame, masks: list[int], *keys: str, items: bool = False) -> DataFrame:
    """(keys, at, seed) of a table with a word array ``w``."""
    lists = materialize(tokens.select(*keys, F.size("w").alias("n_words"),
                                      _seeds("w", masks, items).alias("seeds")))
    flat = lists.select(*keys, "n_words", F.posexplode_outer("seeds").alias("p", "seed"))
    return (flat.where(F.col("seed").isNotNull())
                .select(*keys, F.pmod("p", "n_words").alias("at"), "seed"))


def short_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Items that have too few words to be looked for."""
    return benchmark.where(F.size(words_of(text)) < LEAST).select(item)


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          item: str = "item_id", item_text: str = "text", window: int = WINDOW,
          match: float = MATCH) -> DataFrame:
    """(id, th, item, start, n_item_words, n_equal, best_equal): one row per
    document text, item and diagonal that passes verification.  ``start`` is the
    document word at which the item's first word would lie."""
    items = staged(benchmark.select(F.col(item).alias("item"), words_of(item_text).alias("w"))
                            .where(F.size("w") >= LEAST).distinct(), "benchmark-words")
    masks = _masks_of(items) or [0]
    seeds = staged(_windows(items, masks, "item", items=True).select("item", F.col("at").alias("item_at"), "seed")
                   .distinct(), "benchmark-seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    side = F.broadcast(seeds) if small else seeds

    tokens = materialize(df.select(F.col(key).alias("id"), row_key(text).alias("th"),
                                   words_of(text).alias("w")))
    hits = (_windows(tokens, masks, "id", "th").join(side, "seed")
            .select("id", "th", "item", (F.col("at") - F.col("item_at")).alias("start"))
            .distinct())
    hits = staged(hits, "benchmark-hits")

    # lay the item along the diagonal, in the words of the documents that were hit
    wanted = hits.select(F.col("id").alias("h_id"), F.col("th").alias("h_th"), "item", "start")
    again = df.select(F.col(key).alias("id"), row_key(text).alias("th"), F.col(text).alias("t"))
    docs = (again.join(wanted.select("h_id", "h_th").distinct(),
                       F.col("id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")),
                       "left_semi")
                 .select("id", "th", words_of("t").alias("w")))
    pairs = (docs.join(wanted, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")))
                 .join(items.withColumnRenamed("w", "iw"), "item"))
    first = F.greatest(F.lit(0), F.col("start"))
    part = F.slice("w", first + 1, F.greatest(F.lit(0), F.col("start") + F.size("iw") - first))
    laid = materialize(pairs.select("id", "th", "item", "start", "iw", part.alias("dw"),
                                    (first - F.col("start")).alias("skipped")))
    aligned = F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("skipped")), F.col("dw"))
    equal = F.zip_with("iw", F.slice(aligned, F.lit(1), F.size("iw")),
                       lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    flags = materialize(laid.select("id", "th", "item", "start", equal.alias("eq")))
    n = F.size("eq")
    width = F.least(F.lit(window), n)
    sums = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.aggregate(
        F.slice("eq", i, width), F.lit(0), lambda acc, x: acc + x))
    scored = materialize(flags.select(
        "id", "th", "item", "start", n.alias("n_item_words"), width.alias("width"),
        F.aggregate("eq", F.lit(0), lambda acc, x: acc + x).alias("n_equal"),
        F.array_max(sums).alias("best_equal")))
    needed = F.when(F.col("n_item_words") < WHOLE, F.col("width")).otherwise(
        F.ceil(F.lit(match) * F.col("width")))
    return scored.where(F.col("best_equal") >= needed).drop("width").distinct()


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 **names) -> DataFrame:
    """(key, item_id, n_places, start, n_item_words, n_equal): one row per document
    and leaked item, with the place of most equal words (the first of them)."""
    item = names.get("item", "item_id")
    best = F.min(F.struct((-F.col("n_equal")).alias("o"), "start", "n_item_words", "n_equal"))
    return (leaks(df, benchmark, key, text, **names).groupBy("id", "item")
            .agg(F.countDistinct("start").alias("n_places"), best.alias("b"))
            .select(F.col("id").alias(key), F.col("item").alias(item), "n_places",
                    F.col("b.start").alias("start"), F.col("b.n_item_words").alias("n_item_words"),
                    F.col("b.n_equal").alias("n_equal")))


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  **names) -> DataFrame:
    """``df`` without the rows that hold a benchmark passage.

    The ids to remove are staged, so the anti join is broadcast while they are few."""
    bad = staged(leaks(df, benchmark, key, text, **names)
                 .select(F.col("id").alias("leak__id"), F.col("th").alias("leak__th")).distinct(),
                 "benchmark-leaks")
    return (df.withColumn("row__th", row_key(text))
              .join(bad, F.col(key).eqNullSafe(F.col("leak__id"))
                    & (F.col("row__th") == F.col("leak__th")), "left_anti")
              .drop("row__th"))
