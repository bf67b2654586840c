"""Corpus preparation (P1-P17): dedup, rename, null handling, word counts,
length filters, chronological head and split, profile, sampling.

Scale notes
* Cleaning decides on narrow rows: one scan computes the content hash, the null
  flags and the word counts, and one aggregation by the hash (``min`` combines
  map-side, so a text copied millions of times costs one row per map partition)
  deduplicates them.  Text is fetched by id only where it is written out.
* Chronological positions come from a range-partitioned sort (balanced by
  sampling on the unique key (date, id), so a hot date is split across tasks),
  frozen with a reliable checkpoint, plus per-partition offsets -- no window
  over the whole table and no single-partition exchange.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, word_count
from ..session import ensure_checkpoint_dir

# Pandas ``read_csv`` default missing-value markers.
PANDAS_NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
                    "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
                    "None", "n/a", "nan", "null"]
# Fixed values of the corpus recipe.
RENAMES = {"article_text": "article", "human_summary": "summary",
           "news_category": "category", "published_date": "date"}
REQUIRED = ["article", "summary", "headline"]
SUMMARY_MIN_WORDS, SUMMARY_MAX_WORDS = 50, 250
ARTICLE_MIN_WORDS = 100
HEADLINE_MIN_CHARS = 10
TARGET_ARTICLES = 317498
TARGET_PROFILE = [  # metric, target, tolerance (strict <), exact-match flag
    ("total_articles", 317498.0, 0.0, True),
    ("avg_words_article", 334.21, 10.0, False),
    ("avg_words_summary", 95.45, 5.0, False),
    ("compression_ratio", 3.50, 0.2, False),
]
SPLIT_FRACTIONS = (0.90, 0.05)          # train, val; test takes the rest
SMALL_HEADS = {"train": 1000, "val": 200, "test": 200}
SAMPLE_SEED = 42
#: Hex digits of a sample key that one level of the selection looks at, and the rows of a
#: bucket that are sorted to cut it.
SAMPLE_DIGITS = 3
SAMPLE_CUT = 10_000
TEST_CAP = 200


# P1 -------------------------------------------------------------------------
def content_hash(cols: list[str]) -> Column:
    """SHA-256 over the content columns (sorted by name), each led by its length: no two
    different contents make the same text, and null and '' stay distinct."""
    def part(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("n"))
    return F.sha2(F.concat(*[part(c) for c in sorted(cols)]), 256)


def dedup_keep_first(df: DataFrame, content_cols: list[str], id_col: str) -> DataFrame:
    """Keep one row per distinct content (the smallest id); adds ``copies``."""
    keep = (df.select(id_col, content_hash(content_cols).alias("_h"))
              .groupBy("_h").agg(F.min(id_col).alias(id_col),
                                 F.count(F.lit(1)).alias("copies"))
              .drop("_h"))
    return df.join(keep, id_col, "inner")


# P2 / P3 --------------------------------------------------------------------
def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().replace("\n", "") for c in df.columns])


def rename_columns(df: DataFrame, mapping: dict[str, str] = RENAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


# P4 -------------------------------------------------------------------------
def na_to_null(c) -> Column:
    c = col_(c)
    return F.when(c.isin(*PANDAS_NA_VALUES), F.lit(None).cast("string")).otherwise(c)


def markers_to_null(df: DataFrame) -> DataFrame:
    """Missing-value markers of every string column become nulls, as reading
    the dump does before any other step."""
    return df.withColumns({c: na_to_null(c) for c, t in df.dtypes if t == "string"})


def drop_missing(df: DataFrame, subset: list[str] = REQUIRED, map_na_tokens: bool = True) -> DataFrame:
    return (markers_to_null(df) if map_na_tokens else df).na.drop(subset=subset)


# P5-P8 ----------------------------------------------------------------------
def with_word_counts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "summary_word_count": word_count("summary"),
        "article_word_count": word_count("article")})


def length_predicates() -> dict[str, Column]:
    """Over the columns of ``content_keys``."""
    return {
        "summary_len_ok": F.col("summary_word_count").between(SUMMARY_MIN_WORDS, SUMMARY_MAX_WORDS),
        "article_len_ok": F.col("article_word_count") >= ARTICLE_MIN_WORDS,
        "headline_ok": F.col("headline_chars") >= HEADLINE_MIN_CHARS,
    }


# Small columns that travel with the key of a deduplicated row.
CARRIED = ["category", "date"]


def content_keys(raw: DataFrame, id_col: str = "article_id") -> DataFrame:
    """One narrow row per distinct content (P1): the smallest id, ``copies``,
    ``complete`` (P4), the word counts (P5), ``headline_chars``, category, date.

    Rows of equal content agree in everything derived from it, so a single
    aggregation by the content hash is the whole dedup."""
    d = markers_to_null(raw)
    complete = F.lit(True)
    for c in REQUIRED:
        complete = complete & F.col(c).isNotNull()
    narrow = with_word_counts(d).select(
        id_col, content_hash([c for c in raw.columns if c != id_col]).alias("_h"),
        complete.alias("complete"), "summary_word_count", "article_word_count",
        F.length("headline").alias("headline_chars"), *[c for c in CARRIED if c in raw.columns])
    rest = [c for c in narrow.columns if c not in (id_col, "_h")]
    return (narrow.groupBy("_h").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"),
                                     *[F.first(c).alias(c) for c in rest]).drop("_h"))


def clean_keys(raw: DataFrame, id_col: str = "article_id") -> DataFrame:
    """P1 -> P8 on narrow rows: dedup, dropna, length filters."""
    k = content_keys(raw, id_col).filter("complete")
    for ok in length_predicates().values():
        k = k.filter(ok)
    return k.drop("complete")


def with_text(keys: DataFrame, raw: DataFrame, cols: list[str], id_col: str = "article_id") -> DataFrame:
    """Fetch text columns of ``raw`` for the rows of ``keys``."""
    return keys.join(markers_to_null(raw.select(id_col, *cols)), id_col)


def clean(raw: DataFrame, id_col: str = "article_id") -> DataFrame:
    """The cleaned corpus with its texts and word counts."""
    keys = clean_keys(raw, id_col).select(id_col, "summary_word_count", "article_word_count")
    return with_text(keys, raw, [c for c in raw.columns if c != id_col], id_col)


# P9 / P13 / P14 / P16 -------------------------------------------------------
def global_positions(df: DataFrame, order: list[Column], keep: list[str],
                     pos_col: str = "pos") -> DataFrame:
    """1-based position of every row in the total order ``order``.

    ``order`` must be a unique key.  Only the columns in ``keep`` (the key
    and the order columns) travel through the sort; callers join the
    positions back by key when they need more.  Rows are range-partitioned
    (boundaries sampled on the unique key, so a hot date is split over many
    tasks) and sorted; the layout is frozen with a reliable checkpoint so a
    recomputed partition gets the same numbers; each row then gets its
    partition's offset (from the per-partition row counts) plus its index.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the range partitioner samples its input before shuffling it: keep the
    # narrow key columns so the upstream pipeline runs once, not twice
    keys = df.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    frozen = (keys.repartitionByRange(n_parts, *order)
                  .sortWithinPartitions(*order)
                  .withColumn("_mid", F.monotonically_increasing_id())
                  .checkpoint(eager=True))
    keys.unpersist()
    pid = F.shiftright(F.col("_mid"), 33)
    # rows per partition: one small row per partition reaches the driver
    # (as in RDD.zipWithIndex); offsets become a literal array
    sizes = dict(frozen.groupBy(pid.alias("_pid")).count().collect())
    offsets, acc = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(acc)
        acc += sizes.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets] or [F.lit(0).cast("long")]),
                       (pid + 1).cast("int"))
    local = F.col("_mid") - F.shiftleft(pid, 33)
    return frozen.withColumn(pos_col, (off + local + 1).cast("long")).drop("_mid")


def chronological(df: DataFrame, date: str = "date", id_col: str = "article_id") -> list[Column]:
    return [F.col(date).asc_nulls_last(), F.col(id_col).asc()]


def head_by_date(positioned: DataFrame, n: int = TARGET_ARTICLES, pos_col: str = "pos") -> DataFrame:
    """The first n rows in date order (reuses the positions)."""
    return positioned.filter(F.col(pos_col) <= n)


def assign_splits(positioned: DataFrame, pos_col: str = "pos",
                  fractions=SPLIT_FRACTIONS) -> DataFrame:
    """90/5/5 positional split.  Cut points ``int(.9n)`` and
    ``int(.9n)+int(.05n)``; n comes from a one-row aggregate."""
    n = positioned.agg(F.count(F.lit(1)).alias("_total"))
    train_end = F.floor(F.lit(fractions[0]) * F.col("_total"))
    val_end = train_end + F.floor(F.lit(fractions[1]) * F.col("_total"))
    split = (F.when(F.col(pos_col) <= train_end, F.lit("train"))
              .when(F.col(pos_col) <= val_end, F.lit("val"))
              .otherwise(F.lit("test")))
    start = (F.when(F.col(pos_col) <= train_end, F.lit(0))
              .when(F.col(pos_col) <= val_end, train_end)
              .otherwise(val_end))
    return (positioned.crossJoin(F.broadcast(n))
                      .withColumn("split", split)
                      .withColumn("split_pos", (F.col(pos_col) - start).cast("long"))
                      .drop("_total"))


def small_heads(split_df: DataFrame, sizes: dict[str, int] = SMALL_HEADS) -> DataFrame:
    """The first k rows of each split."""
    cond = F.lit(False)
    for name, k in sizes.items():
        cond = cond | ((F.col("split") == name) & (F.col("split_pos") <= k))
    return split_df.filter(cond)


def test_cap(split_df: DataFrame, n: int = TEST_CAP) -> DataFrame:
    """First n rows of the test split, in file (= position) order."""
    return split_df.filter((F.col("split") == "test") & (F.col("split_pos") <= n))


# P10 ------------------------------------------------------------------------
FUNNEL_STEPS = ["initial", "dedup", "dropna", "summary_length", "article_length",
                "headline_length", "head_by_date"]


def funnel(raw: DataFrame, id_col: str = "article_id", head_n: int = TARGET_ARTICLES) -> DataFrame:
    """Row count after each cleaning step, in one aggregation pass.

    The head-by-date step keeps min(n, head_n) rows of what survives.
    """
    preds = length_predicates()
    s2 = F.col("complete")
    s3 = s2 & F.coalesce(preds["summary_len_ok"], F.lit(False))
    s4 = s3 & F.coalesce(preds["article_len_ok"], F.lit(False))
    s5 = s4 & F.coalesce(preds["headline_ok"], F.lit(False))
    counts = content_keys(raw, id_col).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("initial"),
        F.count(F.lit(1)).alias("dedup"), F.count_if(s2).alias("dropna"),
        F.count_if(s3).alias("summary_length"), F.count_if(s4).alias("article_length"),
        F.count_if(s5).alias("headline_length"))
    counts = counts.withColumn("head_by_date", F.least(F.col("headline_length"), F.lit(head_n).cast("long")))
    stack = ", ".join(f"{i}, '{s}', `{s}`" for i, s in enumerate(FUNNEL_STEPS, start=1))
    return counts.selectExpr(f"stack({len(FUNNEL_STEPS)}, {stack}) AS (step_no, step, rows)")


# P11 / P12 / P17 ------------------------------------------------------------
def profile(df: DataFrame) -> DataFrame:
    """Avg words per article / summary, ratio of the means, distinct
    categories (nulls excluded), row count."""
    return df.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.avg("article_word_count").alias("avg_words_article"),
        F.avg("summary_word_count").alias("avg_words_summary"),
        (F.avg("article_word_count") / F.avg("summary_word_count")).alias("compression_ratio"),
        F.countDistinct("category").alias("unique_categories"))


def target_check(prof: DataFrame, targets: DataFrame) -> DataFrame:
    """Unpivot the profile and compare with ``targets(metric, target, tol,
    exact)``: strict ``abs(v - t) < tol``; exact rows use equality."""
    long = prof.select(F.expr(
        "stack(4, 'total_articles', CAST(total_articles AS DOUBLE), "
        "'avg_words_article', avg_words_article, 'avg_words_summary', avg_words_summary, "
        "'compression_ratio', compression_ratio) AS (metric, value)"))
    j = long.join(targets, "metric")
    ok = F.when(F.col("exact"), F.col("value") == F.col("target")) \
          .otherwise(F.abs(F.col("value") - F.col("target")) < F.col("tol"))
    return j.select("metric", "value", "target", "tol", ok.alias("matches"))


def category_profile(df: DataFrame, by: str = "category") -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("articles"),
        F.avg("article_word_count").alias("avg_article_words"),
        F.avg("summary_word_count").alias("avg_summary_words"),
        F.min("article_word_count").alias("min_article_words"),
        F.max("article_word_count").alias("max_article_words"))


# P15 ------------------------------------------------------------------------
def seeded_sample(df: DataFrame, n: int, id_col: str = "article_id", seed: int = SAMPLE_SEED) -> DataFrame:
    """n rows without replacement, deterministic for a seed: the first n in the
    order of (md5(seed:id), id).  ``sample_key`` is returned so callers can reproduce
    the order.

    Bottom-k selection, without a sort of the table: a histogram of the first
    ``SAMPLE_DIGITS`` digits of the key says in which bucket the n-th row is; rows of
    lower buckets are taken as they come, and the bucket itself is cut in the same way by
    its next digits, until what is left to cut is at most ``SAMPLE_CUT`` rows or all its
    rows have one key.  The table is read once a level (each level divides a bucket by
    4,096), only 4,096 counts a level reach the driver, and nothing is shuffled but counts
    and the last few rows."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = df.select(id_col, key.alias("sample_key"))
    prefix, left, size = "", n, None
    taken = F.lit(False)                       # rows of buckets that are in whole
    while left > 0 and (size is None or size > max(left, SAMPLE_CUT)) and len(prefix) < 32:
        digits = len(prefix) + SAMPLE_DIGITS
        bucket = F.substring("sample_key", 1, digits)
        counts = sorted(keyed.filter(F.col("sample_key").startswith(prefix)).groupBy(bucket.alias("b"))
                             .count().collect())
        lower = None
        for b, size in counts:
            lower = b
            if size >= left:
                break
            left -= size
        if lower is None:                      # no rows
            return _sampled(df, keyed.limit(0), id_col)
        inside = F.col("sample_key").startswith(prefix)
        taken = taken | (inside & (bucket < lower))
        prefix = lower
        if size < left:                        # fewer than n rows in all
            break
    whole = size is not None and size <= left
    last = keyed.filter(F.col("sample_key").startswith(prefix))
    if not whole:
        last = last.orderBy("sample_key", id_col).limit(max(left, 0))
    return _sampled(df, keyed.filter(taken).unionByName(last), id_col)


def _sampled(df: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    return keys if df.columns == [id_col] else df.join(keys, id_col)


# P13 / S5 -------------------------------------------------------------------
def split_corpus(splits: DataFrame, raw: DataFrame, id_col: str = "article_id") -> DataFrame:
    """The split corpus with its texts (article, summary), as it is written out."""
    return with_text(splits.select(id_col, "split", "split_pos"), raw, ["article", "summary"], id_col)


def write_splits(corpus: DataFrame, path: str) -> None:
    """One folder per split; each split is as many files as tasks hold it."""
    corpus.write.mode("overwrite").partitionBy("split").parquet(path)
