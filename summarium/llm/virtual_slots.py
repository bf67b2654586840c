"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots (thousands); bytes are aggregated per
slot, and a versioned map says which shard holds a slot.  Rebalancing edits the
map: slots leave shards that are over the mean and fill those below it, so only
the rows of the moved slots travel.  The law is ``bytes``: shards of near equal
size.

Scale: one narrow shuffle of (slot, bytes) that combines map-side to one row per
slot and task.  Only the slot table -- a fixed number of rows, never a function of
the corpus -- reaches the driver.  Row positions are numbered inside a slot
(thousands of groups), and offset by the rows of the earlier slots of the shard,
so no window spans a whole shard.

Defined cases: a null text counts as empty (size 1); a row without an id is dealt by its
place in the table (stage with ``slotted`` where statistics and positions must agree); rows
equal in id and text share a slot and take neighbouring positions; very long texts count
whole; an empty
table gives an empty result and the untouched initial map; extra columns stay
(``assign``) or are left out (``positions``).
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, text_or_empty

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return (F.octet_length(text_or_empty(text)) + 1).cast("long")


def slot_of(key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    """Virtual slot of a record: its key and text hashed.  Rows without a key are dealt by
    their place in the table too, so that equal ones share no slot."""
    crc = F.crc32(text_or_empty(text).cast("binary"))
    h = (F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key), crc))
          .otherwise(F.xxhash64(F.lit("no key"), crc, F.monotonically_increasing_id())))
    return F.pmod(h, F.lit(slots)).cast("int")


def slotted(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot) of every row, staged: the slots of rows without
    a key hold from here on."""
    return staged(df.select(F.col(key), row_size(text).alias("size"),
                            F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
                            slot_of(key, text, slots).alias("virtual_slot")), "slotted")


def slot_stats(df: DataFrame, key: str = "doc_id", text: str = "text",
               slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """{slot: (bytes, rows)}; at most ``slots`` entries, whatever the input."""
    if "virtual_slot" in df.columns and "size" in df.columns and text not in df.columns:  # ``slotted``
        rows = df.select(F.col("virtual_slot").alias("slot"), "size")
    else:
        rows = df.select(slot_of(key, text, slots).alias("slot"), row_size(text).alias("size"))
    agg = (rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    return {r["slot"]: (r["bytes"], r["rows"]) for r in agg.collect()}


def initial_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt round-robin."""
    return [s % shards for s in range(slots)]


def edit_map(current: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """The next version: slots move only from shards above the mean (or beyond
    the shard count) to shards below it.

    Each over-full shard gives up slots, largest that still fits the excess
    first; the freed slots go, largest first, to the shard with the fewest bytes.
    """
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    freed = []
    for slot, shard in enumerate(current):
        if shard >= shards:
            freed.append(slot)
        else:
            load[shard] += sizes.get(slot, 0)
            held[shard].append(slot)
    mean = sum(sizes.values()) / shards
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-sizes.get(s, 0), s)):
            size = sizes.get(slot, 0)
            if size and load[shard] - size >= mean:
                load[shard] -= size
                freed.append(slot)
    edited = list(current)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(freed, key=lambda s: (-sizes.get(s, 0), s)):
        b, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (b + sizes.get(slot, 0), shard))
    return edited


def map_rows(versions: list[list[int]], stats: dict[int, tuple[int, int]]) -> list[tuple]:
    return [(v, slot, shard, *stats.get(slot, (0, 0)))
            for v, m in enumerate(versions) for slot, shard in enumerate(m)]


def write_map(spark: SparkSession, versions: list[list[int]],
              stats: dict[int, tuple[int, int]], path: str) -> None:
    """Store every version of the map, one folder per version."""
    (spark.createDataFrame(map_rows(versions, stats), MAP_SCHEMA).coalesce(1)
          .write.mode("overwrite").partitionBy("version").parquet(path))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """One version of a stored map (the newest by default), by slot."""
    df = spark.read.parquet(path)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    rows = df.where(F.col("version") == version).select("slot", "shard").collect()
    return [shard for _, shard in sorted(map(tuple, rows))]


def balanced_map(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                 slots: int = SLOTS) -> tuple[list[list[int]], dict[int, tuple[int, int]]]:
    """([version 0, version 1], slot statistics) for ``df``."""
    stats = slot_stats(df, key, text, slots)
    first = initial_map(shards, slots)
    return [first, edit_map(first, {s: b for s, (b, _) in stats.items()}, shards)], stats


def stored_map(spark: SparkSession, stats: dict[int, tuple[int, int]], shards: int, path: str,
               slots: int = SLOTS) -> list[int]:
    """Rebalance the map stored at ``path`` and return its newest version, read back.

    Without a map, version 0 deals the slots round-robin.  The newest version is edited for
    the given sizes and shard count and stored as the next one if that changes it."""
    try:
        newest = spark.read.parquet(path).agg(F.max("version")).first()[0]
        versions = [read_map(spark, path, newest)]
    except AnalysisException:          # no map yet
        newest, versions = 0, [initial_map(shards, slots)]
        _store(spark, versions[0], stats, path, 0)
    edited = edit_map(versions[-1], {s: b for s, (b, _) in stats.items()}, shards)
    if edited != versions[-1]:
        _store(spark, edited, stats, path, newest + 1)
    return read_map(spark, path)


def _store(spark: SparkSession, slot_map: list[int], stats: dict, path: str, version: int) -> None:
    rows = [(slot, shard, *stats.get(slot, (0, 0))) for slot, shard in enumerate(slot_map)]
    (spark.createDataFrame(rows, "slot int, shard int, bytes long, rows long").coalesce(1)
          .write.mode("overwrite").parquet(f"{path}/version={version}"))


def assign(df: DataFrame, slot_map: list[int], key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``df`` with ``virtual_slot`` and ``shard``; no shuffle."""
    spark = df.sparkSession
    lookup = spark.createDataFrame(list(enumerate(slot_map)), "virtual_slot int, shard int")
    kept = [c for c in df.columns if c not in ("virtual_slot", "shard")]
    # the lookup has len(slot_map) rows, fixed by the parameter
    return (df.select(*kept, slot_of(key, text, len(slot_map)).alias("virtual_slot"))
              .join(F.broadcast(lookup), "virtual_slot")
              .select(*kept, "virtual_slot", "shard"))


def positions(df: DataFrame, slot_map: list[int], stats: dict[int, tuple[int, int]],
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, virtual_slot, shard, slot): ``slot`` numbers the rows
    of a shard from 0 without gaps, by virtual slot and then by key."""
    spark = df.sparkSession
    nxt: dict[int, int] = {}
    rows = []
    for v, shard in enumerate(slot_map):
        rows.append((v, shard, nxt.get(shard, 0)))
        nxt[shard] = nxt.get(shard, 0) + stats.get(v, (0, 0))[1]
    lookup = spark.createDataFrame(rows, "virtual_slot int, shard int, first_row long")
    narrow = df if set(df.columns) == {key, "size", "text_crc32", "virtual_slot"} else df.select(
        F.col(key), row_size(text).alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        slot_of(key, text, len(slot_map)).alias("virtual_slot"))
    within = W.partitionBy("virtual_slot").orderBy(F.col(key), "text_crc32", "size")
    numbered = narrow.withColumn("nth", F.row_number().over(within) - 1)
    return (numbered.join(F.broadcast(lookup), "virtual_slot")
            .select(key, "size", "text_crc32", "virtual_slot", "shard",
                    (F.col("first_row") + F.col("nth")).cast("long").alias("slot")))


def write_shards(df: DataFrame, slot_map: list[int], path: str, key: str = "doc_id",
                 text: str = "text", files_per_shard: int = 16) -> None:
    """Write the rows in one folder per shard; a shard is dealt over several
    files by virtual slot so no task writes a whole shard."""
    out = assign(df, slot_map, key, text)
    (out.repartition(files_per_shard * (max(slot_map) + 1), "virtual_slot")
        .write.mode("overwrite").partitionBy("shard").parquet(path))
