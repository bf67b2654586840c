"""Mixing sources to target weights by Poisson replication.

Every document of source s is to appear ``rate`` times on average, where
``rate = weight * total / size`` brings the source to its share of the output.
A hash of (seed, id) gives a uniform number, the Poisson distribution with that
mean is inverted at it, the document is exploded into that many copies, and the
copies are shuffled globally by a second hash.  Everything is built-in columns.

Scale: source sizes combine map-side; the table of rates and cumulative
probabilities has one row per source, is staged, and so is broadcast only when its
written size is below the session's threshold (a skew-split sort-merge join
otherwise).  The only shuffle of texts is the global one, on a hash of (id, copy)
and therefore even for any source or group of copies.

Defined cases: a null source is a source of its own; a null id is replaced by the
hash of the text; rows with the same id are replicated alike, each in its own
right; empty texts have size 1; sources without a target weight get none; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, text_or_empty, unit_hash

SEED = "mix-1"
ALPHA = 0.7


def doc_key(key: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(key).cast("string"),
                      F.concat(F.lit("t"), F.md5(text_or_empty(text).cast("binary"))))


def source_rates(df: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA,
                 epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, rate): the mean number of copies of a document of the source.

    Sizes are UTF-8 bytes plus 1 a document.  ``weights`` is a table (source,
    weight), of any total; without it a source weighs its size to the power
    ``alpha``.  The output is ``epochs`` times as large as the input on average.
    """
    sizes = (df.select(F.col(source).alias("source"),
                       (F.octet_length(text_or_empty(text)) + 1).alias("size"))
               .groupBy("source").agg(F.sum("size").alias("size")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double"))
        weighed = (sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left")
                        .select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    weighed = staged(weighed, "mix-sizes")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return weighed.select("source", "size", F.lit(0.0).alias("rate"))
    scale = F.lit(epochs * total["size"] / total["weight"])
    return weighed.select("source", "size", (scale * F.col("weight") / F.col("size")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, rate, cdf): cdf[k] is P(copies <= k), as far as it differs from 1.

    Computed in logarithms, so that large rates do not underflow."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    terms = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = W.partitionBy("source").orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double")))
                          .otherwise(F.lit(0.0))).over(upto)
    p = F.when(F.col("rate") > 0,
               F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial")))
    mass = (terms.withColumn("log_factorial", log_factorial)
                 .withColumn("p", F.coalesce(p, (F.col("k") == 0).cast("double")))
                 .withColumn("c", F.sum("p").over(upto)))
    return (mass.groupBy("source", "rate")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))),
                                 lambda x: x["c"]).alias("cdf")))


def replicate(df: DataFrame, tables: DataFrame, seed: str = SEED, key: str = "doc_id",
              source: str = "source", text: str = "text") -> DataFrame:
    """Every row as often as its inverted Poisson draw says, with ``copy`` (from 1)
    and ``shuffle_key``; the rows are not yet shuffled."""
    t = tables.select(F.col("source").alias("mix__source"), F.col("cdf").alias("mix__cdf"))
    kept = [c for c in df.columns if c not in ("copy", "shuffle_key")]
    drawn = (df.select(*kept)
               .withColumn("mix__u", unit_hash(F.lit(seed), doc_key(key, text)))
               .join(t, F.col(source).eqNullSafe(F.col("mix__source"))))
    copies = F.size(F.filter("mix__cdf", lambda c: c <= F.col("mix__u")))
    out = (drawn.withColumn("mix__n", copies).where(F.col("mix__n") > 0)
                .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix__n")))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), doc_key(key, text),
                               F.col("copy").cast("string")).cast("binary"))
    order = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return out.select(*kept, "copy", order.alias("shuffle_key"))


def shuffle_globally(df: DataFrame) -> DataFrame:
    """Random order over the whole table: dealt by a hash of the shuffle key, then
    ordered by the key in each partition (no sampling pass, no hot partition)."""
    return df.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def mix(df: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA,
        epochs: float = 1.0, seed: str = SEED, key: str = "doc_id", source: str = "source",
        text: str = "text") -> DataFrame:
    """The mixed corpus: all columns of ``df``, ``copy`` and ``shuffle_key``."""
    rates = source_rates(df, weights, alpha, epochs, source, text)
    tables = staged(poisson_tables(rates), "mix-rates")
    return shuffle_globally(replicate(df, tables, seed, key, source, text))
