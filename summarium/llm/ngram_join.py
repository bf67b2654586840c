"""N-gram Jaccard self-join by T-occurrence search with DivideSkip.

A document is the set of its distinct word shingles (``SHINGLE`` words), as sorted 64-bit
hashes.  Two documents link when their sets' Jaccard similarity is at least ``PERCENT`` / 100.

1. Blocks.  Sets whose similarity reaches the threshold differ in at most
   ``d = (|a| + |b|) * (100 - p) / (100 + p)`` shingles.  The hash range is cut into so many
   parts that linked sets agree in a whole part (for small sets more than ``d``; for large
   ones the bound ``MISS`` of the chance that they do not is 1e-10, in the order of the
   64-bit names): equal part signatures make an edge, and the connected components of
   these edges are blocks that no link leaves.
   Sets are cut by size class (and again for pairs astride two classes), so both of a
   pair use the same cut.  There are spare parts, so that parts of one or two shingles,
   which texts with a passage in common often share, need not be signed.
2. Search.  Inside a block every set queries the inverted lists of the sets not larger
   than it.  A partner must stand in at least T of the query's lists.  DivideSkip sets
   the L longest lists aside, merges the short ones through a heap, keeps what occurs
   T - L times there, and probes the long lists by binary search.  Blocks beyond
   ``TASK_SHINGLES`` are cut by size and then by name into chunks, and pairs of chunks that
   links can join are searched on their own.
3. Components of the links.

Scale: equal sets collapse to one name (64-bit) before any search, first within each
slice of ``EMIT_ROWS`` documents; a signature leaves a slice once, whatever number of its
documents bear it, so a signature of very many documents is pre-aggregated.  Texts move only for members of a
block.  Link counts are made inside the tasks; no pair is emitted.

Defined cases: words are runs without ASCII white space, A-Z lower-cased; texts of fewer
words are one shingle; null, empty and blank texts are the empty set, linked with nothing;
repeated rows and equal sets are links; a null id counts as a row of its class and is
never its smallest id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key, staged
from .components import connected_components

SHINGLE = 5
PERCENT = 80
#: Shingles that one search task holds in each of its two chunks.
TASK_SHINGLES = 1 << 19
#: Block members up to which their keys are broadcast to the scan (about 40 MB).
BROADCAST_MEMBERS = 500_000
#: Cost of probing against merging in DivideSkip's choice of L.
MU = 0.5
#: Parts of fewer shingles are not signed while spare parts make up for them.
STRONG = 5
#: Bound on the chance that a linked pair of large sets agrees in no signed part.
MISS = 1e-10
#: Sizes up to which the size classes are narrow.
FINE = 64
#: Documents that are signed together.
EMIT_ROWS = 1024
#: Lists with fewer entries in all are merged by a heap; beyond, by counting.
HEAP_ENTRIES = 128

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                         0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                         0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """Word to 64-bit hash; forgets all when it holds too many (some 20 MB)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHash()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    # bytes.lower and bytes.split know ASCII letters and white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k word hashes."""
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc += h[j:n + j] * _MULTIPLIERS[j % len(_MULTIPLIERS)] + np.uint64(j // len(_MULTIPLIERS))
        if k > len(_MULTIPLIERS):
            acc = _mix(acc)
    return _mix(acc)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(gram_hashes(h, min(k, len(h))))


@lru_cache(maxsize=None)
def _borders(percent: int) -> list[int]:
    """Upper ends of the size classes: as narrow as a link reaches for small sets,
    doubling beyond ``FINE``."""
    out = [1]
    while out[-1] < 1 << 40:
        x = out[-1]
        out.append(max(x + 1, x * 100 // percent) if x < FINE else 2 * x)
    return out


@lru_cache(maxsize=1 << 16)
def _parts(d: int) -> tuple[int, int]:
    """(parts, spare) of a cut for sets that differ in at most d shingles.

    More than d parts cannot all be hit.  Fewer parts hold more shingles each, and the
    hash throws the d differences into them at random: the chance that all but the
    spare ones are hit is at most (1 - (1 - 1/parts)^d)^(parts - spare), as hits of
    different parts are negatively associated.  The fewest parts that keep it below
    ``MISS`` are taken where they are fewer than d + 1 and the spare ones."""
    spare = (1 if d else 0) + d // 8
    sure = d + 1 + spare
    for parts in range(max(2, d // 4), sure):
        hit = 1 - (1 - 1 / parts) ** d
        if (parts - parts // 8) * math.log(hit) <= math.log(MISS):
            return parts, parts // 8
    return sure, spare


@lru_cache(maxsize=1 << 16)
def _cuts(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(tag, parts, spare) of the cuts in which a set of size n signs: one for pairs
    within its size class, one for pairs astride each class border that a link of n
    can cross."""
    borders = _borders(percent)
    out = []

    def cut(tag: int, a: int, b: int) -> None:
        out.append((tag, *_parts((a + b) * (100 - percent) // (100 + percent))))

    i = bisect.bisect_left(borders, n)
    cut(2 * i, borders[i], borders[i])
    j = i
    while borders[j] < n * 100 // percent:         # partners above the border
        cut(2 * j + 1, borders[j], borders[j] * 100 // percent)
        j += 1
    j = i - 1
    while j >= 0 and n * percent <= borders[j] * 100:  # partners at or below it
        cut(2 * j + 1, borders[j], borders[j] * 100 // percent)
        j -= 1
    return tuple(out)


def signatures(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Part signatures of a sorted shingle set.

    Of the parts of a linked pair ``spare + 1`` or more agree.  A set
    leaves out its parts of fewer than t shingles for the largest t up to ``STRONG``
    that leaves out ``spare`` of them at most; an agreeing part that the larger t of
    the two lets stand is then signed by both."""
    n = len(tokens)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(tokens ^ np.uint64(0x5BD1E995)),
                                                               dtype=np.uint64)])
    out = []
    for tag, parts, spare in _cuts(n, percent):
        # the parts are ranges of the hash, so a sorted set is cut by binary search
        width = ((1 << 64) - 1) // parts
        bounds = np.arange(1, parts, dtype=np.uint64) * np.uint64(width)
        at = np.concatenate([[0], np.searchsorted(tokens, bounds), [n]])
        sums = total[at[1:]] - total[at[:-1]]
        number = np.arange(parts, dtype=np.uint64) + (np.uint64(tag) << np.uint64(40))
        sig = _mix(sums + _mix(number))
        held = at[1:] - at[:-1]
        t = STRONG
        while (held < t).sum() > spare:
            t -= 1
        out.append(sig[held >= t])
    return np.concatenate(out)


def set_name(tokens: np.ndarray) -> int:
    """64-bit name of a shingle set (signed)."""
    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


_EMIT = "sig long, name long, doc_id long, th long, n long"


def _emit(percent: int, k: int):
    """One row (name, doc_id, th, n) for every document; (sig, name) for every signature
    of the batch with the smallest name that bears it; (name, doc_id = smallest name,
    n = -1) to join the others of the batch to that name."""
    columns = ["sig", "name", "doc_id", "th", "n"]

    def table(rows, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [given[c] if c in given else pa.nulls(rows, pa.int64()) for c in columns], names=columns)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMIT_ROWS):
                yield batch.slice(at, EMIT_ROWS)
        # a worker lives on after its task: give back what it held
        _WORDS.clear()
        pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2)
            sizes, names = [], []
            known: dict[int, np.ndarray] = {}
            for t in texts:
                tokens = shingle_set(t.as_py(), k)
                sizes.append(len(tokens))
                if not len(tokens):
                    names.append(None)
                    continue
                name = set_name(tokens)
                names.append(name)
                if name not in known:
                    known[name] = signatures(tokens, percent).view(np.int64)
            yield table(len(names), name=pa.array(names, pa.int64()), doc_id=batch.column(0),
                        th=batch.column(1), n=pa.array(sizes, pa.int64()))
            if not known:
                continue
            sig = np.concatenate(list(known.values()))
            name = np.repeat(np.fromiter(known, np.int64, len(known)),
                             [len(v) for v in known.values()])
            order = np.lexsort((name, sig))
            sig, name = sig[order], name[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            least = name[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
            yield table(int(first.sum()), sig=pa.array(sig[first]), name=pa.array(name[first]))
            pairs = np.unique(np.stack([name, least], 1)[name != least], axis=0)
            yield table(len(pairs), name=pa.array(pairs[:, 0]), doc_id=pa.array(pairs[:, 1]),
                        n=pa.array(np.full(len(pairs), -1, np.int64)))
    return run


def merge_counts(lists: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, occurrences) over sorted lists of numbers below m."""
    total = sum(map(len, lists))
    if total <= HEAP_ENTRIES:
        merged = [(x, sum(1 for _ in g)) for x, g in groupby(heapq.merge(*[x.tolist() for x in lists]))]
        return (np.array([x for x, _ in merged], np.int64), np.array([c for _, c in merged], np.int64))
    counts = np.bincount(np.concatenate(lists), minlength=m)
    members = np.flatnonzero(counts)
    return members, counts[members]


def block_links(sets: list[np.ndarray], crossing: np.ndarray | None = None,
                percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(query, partners) for every set of a block, each link once.  ``crossing`` marks
    the sets of the second chunk: then only links between the chunks are looked for."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    rank = np.argsort(sizes, kind="stable")
    sizes = sizes[rank]
    flat = np.concatenate([sets[i] for i in rank])
    holder = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")          # lists by shingle, members ascending
    inverted = holder[order]
    first = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    starts = np.append(np.flatnonzero(first), len(flat))
    list_of = np.empty(len(flat), np.int64)
    list_of[order] = np.cumsum(first) - 1
    ends = np.cumsum(sizes)
    other = crossing[rank] if crossing is not None else None
    for q in range(1, m):
        n = int(sizes[q])
        low = int(np.searchsorted(sizes[:q], -(-percent * n // 100)))
        if low == q:
            continue
        lists = list_of[ends[q] - n:ends[q]]
        lengths = starts[lists + 1] - starts[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        T = -(-percent * n // 100)
        longest = int(lengths.max())
        L = min(T - 1, int(T / (MU * math.log2(longest + 1) + 1)))
        short, long = lists[:n - L], lists[n - L:]
        members, counts = merge_counts([inverted[starts[x]:starts[x + 1]] for x in short], m)
        keep = (members >= low) & (members < q) & (counts >= T - L)
        if other is not None:
            keep &= other[members] != other[q]
        members, counts = members[keep], counts[keep]
        need = -(-percent * (n + sizes[members]) // (100 + percent))
        left = len(long)
        for x in long:
            alive = counts + left >= need
            if not alive.all():
                members, counts, need = members[alive], counts[alive], need[alive]
            if not len(members):
                break
            entries = inverted[starts[x]:starts[x + 1]]
            at = np.minimum(np.searchsorted(entries, members), len(entries) - 1)
            counts = counts + (entries[at] == members)
            left -= 1
        linked = members[100 * counts >= percent * (n + sizes[members] - counts)]
        if len(linked):
            yield int(rank[q]), rank[linked]


def _search(percent: int, k: int):
    """Of one task's blocks: (name, root, n_links) for every set of the task."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in rows.groupby("group", sort=False):
            block = block.drop_duplicates("name")
            names = block["name"].to_numpy(np.int64)
            copies = block["copies"].to_numpy(np.int64)
            crossing = block["side"].to_numpy() if block["cross"].iat[0] else None
            parent = np.arange(len(names))

            def find(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            links = np.zeros(len(names), np.int64)
            for q, partners in block_links([shingle_set(t, k) for t in block["text"]], crossing, percent):
                links[q] += copies[partners].sum()
                links[partners] += copies[q]
                for p in partners:
                    a, b = find(q), find(int(p))
                    if a != b:
                        if names[b] < names[a]:
                            a, b = b, a
                        parent[b] = a
            out.append(pd.DataFrame({"name": names, "root": names[[find(i) for i in range(len(names))]],
                                     "n_links": links}))
        _WORDS.clear()
        return pd.concat(out)
    return run


def _linked_classes(docs: DataFrame, key: str, text: str, percent: int, k: int,
                    task_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, th, name, n_shingles), and its classes (name, component_id,
    kept, n_links): ``kept`` is the (doc_id, th) that stands for the component."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(text).alias("th"),
                       F.col(text).alias("text"))
    # one shuffle by signature; rows that are no signature are dealt by their name
    emitted = (rows.mapInArrow(_emit(percent, k), _EMIT)
                   .withColumn("part", F.coalesce("sig", F.xxhash64("name", "doc_id"))))
    least = F.min("name").over(W.partitionBy("part", "sig"))
    signed = F.col("sig").isNotNull()
    seen = (emitted.withColumn("least", least)
                   .where(~signed | (F.col("name") != F.col("least")))
                   .select(F.when(signed, F.lit(-1)).otherwise(F.col("n")).alias("n"), "name", "th",
                           F.when(signed, F.col("least")).otherwise(F.col("doc_id")).alias("other")))
    seen = staged(seen, "shingle-sets")
    every = seen.where("n >= 0").select(F.col("other").alias("doc_id"), "th", "name",
                                        F.col("n").alias("n_shingles"))
    sets = staged(every.where(F.col("name").isNotNull()).groupBy("name")
                       .agg(F.min("doc_id").alias("least_id"),
                            F.min(F.struct("doc_id", "th")).alias("bearer"),
                            F.count("*").alias("copies"), F.max("n_shingles").alias("n")),
                  "shingle-classes")

    blocks = connected_components(seen.where("n = -1").select(F.col("name").alias("u"),
                                                              F.col("other").alias("v")))
    roots = blocks.select("root").distinct().select(F.col("root").alias("name"), F.col("root").alias("block"))
    members = staged(blocks.select(F.col("node").alias("name"), F.col("root").alias("block"))
                           .unionByName(roots).join(sets, "name"), "block-members")
    found = _search_blocks(rows, members, percent, k, task_shingles)

    links = found.groupBy("name").agg(F.sum("n_links").alias("n_links"))
    parts = connected_components(found.where("name <> root")
                                      .select(F.col("name").alias("u"), F.col("root").alias("v")))
    rooted = staged(sets.join(parts.withColumnRenamed("node", "name"), "name", "left")
                        .join(links, "name", "left")
                        .select("name", "least_id", "bearer", "copies",
                                F.coalesce("root", "name").alias("root"),
                                F.coalesce("n_links", F.lit(0)).alias("n_links")), "linked-classes")
    whole = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"),
                                       F.min("bearer").alias("kept"))
    return every, rooted.join(whole, "root").select(
        "name", "component_id", "kept", (F.col("n_links") + F.col("copies") - 1).alias("n_links"))


def linked_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     percent: int = PERCENT, k: int = SHINGLE,
                     task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """(key, n_shingles, component_id, n_links, set_name) for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links; ``n_links`` counts the other
    rows that a row links with, equal ones included."""
    every, classes = _linked_classes(docs, key, text, percent, k, task_shingles)
    full = every.where(F.col("name").isNotNull()).join(classes, "name").select(
        "doc_id", "n_shingles", "component_id", "n_links", F.col("name").alias("set_name"))
    empty = every.where(F.col("name").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("set_name"))
    return full.unionByName(empty).withColumnRenamed("doc_id", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
             k: int = SHINGLE, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest id.  Empty sets stay.

    The ids that go are broadcast while they are few, so texts are not shuffled."""
    every, classes = _linked_classes(docs, key, text, percent, k, task_shingles)
    rows = every.where(F.col("name").isNotNull()).join(classes, "name")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th"))
    marked = staged(rows.groupBy("doc_id", "th").agg(F.max(stays).alias("stays"),
                                                     F.count("*").alias("copies"))
                        .where(~F.col("stays") | (F.col("copies") > 1)), "linked-rows")
    n = marked.groupBy("stays").count().collect()
    few = sum(r["count"] for r in n) <= BROADCAST_MEMBERS
    gone = marked.select(F.col("doc_id").alias("gone__id"), F.col("th").alias("gone__th"))
    keyed = docs.withColumn("row__th", row_key(text))
    same = F.col(key).eqNullSafe(F.col("gone__id")) & (F.col("row__th") == F.col("gone__th"))
    out = keyed.join(F.broadcast(gone) if few else gone, same, "left_anti")
    if any(r["stays"] for r in n):  # a kept row that stands in the table more than once
        again = marked.where("stays").select(F.col("doc_id").alias("gone__id"), F.col("th").alias("gone__th"))
        out = out.unionByName(keyed.join(again, same, "left_semi").dropDuplicates([key, "row__th"]))
    return out.drop("row__th")


def _once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows repeated in id and text leave a batch once."""
    for batch in batches:
        for at in range(0, len(batch), EMIT_ROWS):
            yield batch.iloc[at:at + EMIT_ROWS].drop_duplicates(["group", "name"])


def _subtasks(members: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """``members`` once for every search it takes part in: (group, cross, side).

    A block of at most ``task_shingles`` is one group.  A larger one is cut into bands
    of sizes that a link spans at most two of, and a band into chunks by name; a group is
    a chunk, two chunks of a band, or a chunk of a band and one of the next, of which
    only the links between the two (``cross``) are looked for."""
    width = F.log(F.lit(100 / percent * 1.003))   # wider than a link reaches
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    weight = members.groupBy("block").agg(F.sum("n").alias("shingles"))
    large = F.col("shingles") > task_shingles
    sized = banded.join(weight, "block")
    small = sized.where(~large).select(
        "name", "bearer", "block", "copies", "n", F.col("block").alias("group"),
        F.lit(False).alias("cross"), F.lit(0).alias("side"))
    cut = sized.where(large)
    units = cut.groupBy("block", "band").agg(
        F.ceil(F.sum("n") / F.lit(task_shingles)).cast("int").alias("chunks"))

    def neighbour(step: int, name: str) -> DataFrame:
        return units.select("block", (F.col("band") - step).alias("band"), F.col("chunks").alias(name))

    told = (cut.join(units, ["block", "band"])
               .join(neighbour(1, "above"), ["block", "band"], "left")
               .join(neighbour(-1, "below"), ["block", "band"], "left")
               .withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")))

    def upto(c: str):
        return F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(
            F.array().cast("array<int>"))

    def group(band, first, second, kind):
        return F.xxhash64("block", band, first, second, F.lit(kind))

    me, band = F.col("chunk"), F.col("band")
    inside = F.transform(upto("chunks"), lambda j: F.struct(
        group(band, F.least(me, j), F.greatest(me, j), 0).alias("group"), (j != me).alias("cross"),
        (me > j).cast("int").alias("side")))
    up = F.transform(upto("above"), lambda j: F.struct(
        group(band, me, j, 1).alias("group"), F.lit(True).alias("cross"), F.lit(0).alias("side")))
    down = F.transform(upto("below"), lambda j: F.struct(
        group(band - 1, j, me, 1).alias("group"), F.lit(True).alias("cross"), F.lit(1).alias("side")))
    return small.unionByName(
        told.select("name", "bearer", "block", "copies", "n", F.explode(F.concat(inside, up, down)).alias("g"))
            .select("name", "bearer", "block", "copies", "n", "g.*"))


def _search_blocks(rows: DataFrame, members: DataFrame, percent: int, k: int,
                   task_shingles: int) -> DataFrame:
    """(name, root, n_links) of every member of a block, from each group it was in."""
    cut = staged(_subtasks(members, percent, task_shingles).select(
        F.col("bearer.doc_id").alias("b_id"), F.col("bearer.th").alias("b_th"),
        "name", "copies", "n", "group", "cross", "side"), "block-groups")
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # groups share tasks of about task_shingles
    cut = cut.drop("n").withColumn(
        "task", F.pmod(F.xxhash64("group"), F.lit(max(1, int(total) // task_shingles + 1))))
    # the scan keeps the members' texts (their keys are broadcast while they are few);
    # only those texts are shuffled to their tasks
    keys = members.select(F.col("bearer.doc_id").alias("b_id"), F.col("bearer.th").alias("b_th"))
    few = members.count() <= BROADCAST_MEMBERS
    bears = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th"))
    own = rows.join(F.broadcast(keys) if few else keys, bears, "left_semi")
    texts = own.join(cut, bears).select("task", "group", "name", "copies", "cross", "side", "text")
    found = (texts.mapInPandas(_once, texts.schema).groupBy("task")
                  .applyInPandas(_search(percent, k), "name long, root long, n_links long"))
    return staged(found, "block-links")
