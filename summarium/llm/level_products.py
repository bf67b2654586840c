"""Divergence of the sources of a language, priced from one-hot level products.

For every kept term a group (lang, source) has a count, and equal counts of a group are
one level.  An indicator column for every (group, level) over the terms, multiplied by its
transpose, gives the joint table of every two groups: how many terms stand at level a in
one and at level b in the other.  The divergence of two groups is the sum over the joint
table of its entries times the price f of the two levels, so each distinct pair of levels
is priced once and not once a term.

    p = 1 + floor(10^9 * (count + 2) / (N + 2 V)),  f(p, q) = floor((p - q)^2 / (p + q))

1. Tally.  One pass over the texts counts terms by (lang, source) and documents by lang,
   combined inside each task; a task hands on what it holds at ``TALLY_ENTRIES`` entries.
   The rows are dealt by (lang, term), where terms of too few documents go before anything
   is unpacked.
2. Blocks.  The terms of a language are cut into blocks of about ``TERMS`` of near equal
   total count, where the counts of a group take few levels, and groups into blocks of
   ``GROUPS``; a task multiplies the indicators of one block of terms for two blocks of
   groups (0/1 matrices in single precision: sums below 2^24 are exact), in tiles of
   ``TILE`` columns.  Level 0 is a column too.  Prices are 64-bit integers.
3. Sums of the priced tables over the blocks of terms.

Scale: no row for each pair of groups and term is ever made; what a task holds is bounded
by the parameters.  The output has a row for each pair of sources of a language, as it is
asked for.  A frequent term is one row a task before the shuffle; a hot source is many
entries of many terms, dealt by term.  Counts are 64-bit, p is computed in decimals, so
nothing overflows below 9 * 10^18 occurrences.

Defined cases: null text, lang and source are ''; a text without terms (null, empty,
digits only) still makes its group occur; a language without kept terms has value 0 for
every pair and no term rows; ties go to the smaller item in UTF-8 order; repeated rows
count each; very long texts are counted whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

MIN_DOCS = 10
TOP_TERMS = 10
#: Terms of a block, groups of a block, columns of a tile of a product.
TERMS = 256
GROUPS = 32
TILE = 2048
#: Entries that a task counts before it hands them on (some 40 MB).
TALLY_ENTRIES = 300_000
#: Terms of a tally that leave in one Arrow batch.
BATCH_TERMS = 20_000

_TALLY = "lang string, term string, docs long, sources array<string>, counts array<long>"
#: Byte table: ASCII letters in lower case, other ASCII as a space, UTF-8 bytes beyond kept.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
                    for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters and of code points beyond ASCII."""
    return raw.translate(_TERM_BYTES).split()


def _packed(lang: str, docs: Counter, counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """The tally of one language, a row a term."""
    terms = list(docs)
    number = dict(zip(terms, range(len(terms))))
    at = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int64, len(c))
                         for c in counts.values()])
    n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts.values()])
    source = np.repeat(np.arange(len(counts)), [len(c) for c in counts.values()])
    order = np.argsort(at, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))])
    names = pa.array(list(counts), pa.string())
    for lo in range(0, len(terms), BATCH_TERMS):
        hi = min(lo + BATCH_TERMS, len(terms))
        held = order[ends[lo]:ends[hi]]
        offsets = pa.array(ends[lo:hi + 1] - ends[lo], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (hi - lo), pa.string()),
             pa.array(terms[lo:hi], pa.binary()).cast(pa.string()),
             pa.array([docs[t] for t in terms[lo:hi]], pa.int64()),
             pa.ListArray.from_arrays(offsets, names.take(pa.array(source[held]))),
             pa.ListArray.from_arrays(offsets, pa.array(n[held]))],
            names=["lang", "term", "docs", "sources", "counts"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to documents and counts by source of every term."""
    docs: dict[str, Counter] = {}
    counts: dict[str, dict[str, Counter]] = {}
    entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in docs.items():
            if c:
                yield from _packed(lang, c, counts[lang])
        docs.clear()
        counts.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts):
            terms = terms_of(text.as_py())
            of_lang = docs.setdefault(lang, Counter())
            of_source = counts.setdefault(lang, {}).setdefault(source, Counter())
            before = len(of_source)
            of_lang.update(set(terms))
            of_source.update(terms)
            entries += len(of_source) - before
            if entries >= TALLY_ENTRIES:
                yield from flush()
                entries = 0
    yield from flush()


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def joint_tables(term: np.ndarray, column: np.ndarray, columns: int, left: np.ndarray,
                 right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left column, right column, terms at both) of the product of the indicators with
    their transpose, tile by tile, where it isn't 0."""
    hot = np.zeros((int(term.max()) + 1 if len(term) else 0, columns), np.float32)
    hot[term, column] = 1
    for i in range(0, len(left), TILE):
        a = left[i:i + TILE]
        for j in range(0, len(right), TILE):
            b = right[j:j + TILE]
            joint = hot[:, a].T @ hot[:, b]
            x, y = np.nonzero(joint)
            yield a[x], b[y], joint[x, y].astype(np.int64)


def priced_block(entries: pd.DataFrame, groups: pd.DataFrame, per_block: int = GROUPS) -> pd.DataFrame:
    """Sums of the priced joint tables of one block of terms and two blocks of groups."""
    groups = groups.sort_values("g", ignore_index=True)
    g = groups["g"].to_numpy(np.int64)
    n_terms = int(groups["n_terms"].iat[0])
    lo, hi = int(groups["gi"].iat[0]), int(groups["gj"].iat[0])
    term, codes = pd.factorize(entries["term"])
    at = np.searchsorted(g, entries["g"].to_numpy(np.int64))
    p = entries["p"].to_numpy(np.int64)
    # columns: a level 0 for every group, then the levels met
    level = np.stack([at, p], 1)
    levels, column = np.unique(level, axis=0, return_inverse=True) if len(at) else (level, at)
    column = column.reshape(-1) + len(g)
    group_of = np.concatenate([np.arange(len(g)), levels[:, 0]]).astype(np.int64)
    price_of = np.concatenate([groups["p0"].to_numpy(np.int64), levels[:, 1]])
    absent = np.ones((len(codes), len(g)), bool)
    absent[term, at] = False
    t0, g0 = np.nonzero(absent)
    term, column = np.concatenate([term, t0]), np.concatenate([column, g0])
    block = g[group_of] // per_block
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    total = np.zeros((len(g), len(g)), np.int64)
    for a, b, joint in joint_tables(term, column, len(group_of), left, right):
        np.add.at(total, (group_of[a], group_of[b]), joint * price(price_of[a], price_of[b]))
    # terms of the block without an entry in these groups stand at level 0 in all of them
    p0 = groups["p0"].to_numpy(np.int64)
    total += (n_terms - len(codes)) * price(p0[:, None], p0[None, :])
    x, y = np.nonzero((g[:, None] // per_block == lo) & (g[None, :] // per_block == hi))
    return pd.DataFrame({"lang": groups["lang"].iat[0], "g": g[x], "h": g[y], "value": total[x, y]})


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count, exact."""
    scaled = (n + 2).cast("decimal(20,0)") * F.lit(10 ** 9).cast("decimal(10,0)")
    whole = F.call_function("div", scaled, (total + 2 * terms).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + whole.cast("long")


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, lang: str = "lang",
                source: str = "source", text: str = "text") -> DataFrame:
    """(lang, term, source, n, total) of every kept term and source that holds it;
    ``total`` is the count in the language.  One shuffle, by (lang, term)."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a)
                         for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    # the first column is the one that a sort compares by value before whole rows
    of_term = W.partitionBy("term", "lang")
    held = (rows.mapInArrow(_tally, _TALLY)
                .withColumn("held", F.sum("docs").over(of_term)).where(F.col("held") >= min_docs)
                .select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
                .groupBy("lang", "term", F.col("x.sources").alias("source"))
                .agg(F.sum("x.counts").alias("n")))
    return held.withColumn("total", F.sum("n").over(of_term))


def group_table(docs: DataFrame, counts: DataFrame, lang: str = "lang",
                source: str = "source") -> DataFrame:
    """(lang, source, g, n_groups, total, lang_total, terms) of every occurring group:
    its number in the language, N of the group and of the language, V."""
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"),
                         F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = (counts.groupBy("lang", "term").agg(F.first("total").alias("n"))
               .groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total")))
    zero = F.lit(0).cast("long")
    numbered = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left")
    return numbered.select(
        "lang", "source",
        (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("g"),
        F.count("*").over(W.partitionBy("lang")).alias("n_groups"),
        F.coalesce("total", zero).alias("total"), F.coalesce("lang_total", zero).alias("lang_total"),
        F.coalesce("terms", zero).alias("terms"))


def _dealt(df: DataFrame, per_block: int) -> DataFrame:
    """Every row once for each pair of blocks of groups that its group takes part in."""
    own = F.floor(F.col("g") / per_block).cast("int")
    others = F.sequence(F.lit(0), F.floor((F.col("n_groups") - 1) / per_block).cast("int"))
    return (df.withColumn("other", F.explode(others))
              .withColumn("gi", F.least(own, "other")).withColumn("gj", F.greatest(own, "other"))
              .drop("other"))


def pair_values(counts: DataFrame, groups: DataFrame, terms: int = TERMS,
                per_block: int = GROUPS) -> DataFrame:
    """(lang, g, h, value) of every two groups of a language with kept terms."""
    banded = counts.withColumn("band", F.floor(F.log2(F.col("total").cast("double"))).cast("int"))
    sizes = (banded.groupBy("lang", "term").agg(F.first("band").alias("band"))
                   .groupBy("lang", "band").agg(F.ceil(F.count("*") / terms).alias("chunks")))
    cut = staged(banded.join(sizes, ["lang", "band"])
                       .join(groups, ["lang", "source"])
                       .select("lang", "band", "term", "g", "n_groups",
                               share(F.col("n"), groups["total"], F.col("terms")).alias("p"),
                               F.pmod(F.xxhash64(F.lit("block"), "term"), "chunks").alias("chunk")),
                 "level-entries")
    key = ["lang", "band", "chunk", "gi", "gj"]
    blocks = staged(cut.select("lang", "band", "chunk", "term").distinct()
                       .groupBy("lang", "band", "chunk").agg(F.count("*").alias("n_terms")), "level-blocks")
    zero = groups.where("terms > 0").select(
        "lang", "g", "n_groups", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("p0"))
    levels0 = _dealt(blocks.join(zero, "lang"), per_block)
    priced = (_dealt(cut, per_block).groupBy(*key).cogroup(levels0.groupBy(*key))
              .applyInPandas(lambda entries, zeros: priced_block(entries, zeros, per_block),
                             "lang string, g long, h long, value long"))
    one_way = priced.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    apart = F.floor(F.col("g") / per_block) != F.floor(F.col("h") / per_block)
    there, back = F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"))
    # both ways from one row, so that the blocks are priced once
    both = F.explode(F.when(apart, F.array(there, back)).otherwise(F.array(there)))
    return one_way.select("lang", both.alias("x"), "value").select("lang", "x.g", "x.h", "value")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang: str = "lang",
               source: str = "source", text: str = "text", terms: int = TERMS,
               per_block: int = GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds the divergence from
    every other source of the language, part ``term`` the ``top`` terms that a source uses
    more than its language."""
    counts = staged(term_counts(docs, min_docs, lang, source, text), "level-counts")
    groups = staged(group_table(docs, counts, lang, source), "level-groups")

    values = pair_values(counts, groups, terms, per_block).withColumnRenamed("lang", "of")
    one = groups.select("lang", "source", "g")
    two = groups.select(F.col("lang").alias("of2"), F.col("source").alias("item"), F.col("g").alias("h"))
    pairs = (one.join(two, (F.col("lang") == F.col("of2")) & (F.col("g") != F.col("h")))
                .withColumnRenamed("g", "g1").withColumnRenamed("h", "h1")
                .join(values, (F.col("lang") == F.col("of")) & (F.col("g1") == F.col("g"))
                      & (F.col("h1") == F.col("h")), "left")
                .select("lang", "source", F.lit("pair").alias("part"), "item",
                        F.coalesce("value", F.lit(0).cast("long")).alias("value")))

    p = share(F.col("n"), groups["total"], F.col("terms"))
    q = share(counts["total"], F.col("lang_total"), F.col("terms"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = (counts.join(groups, ["lang", "source"])
                 .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
                 .where("p > q")
                 .select("lang", "source", F.lit("term").alias("part"), "item",
                         F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
                 .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(own)
