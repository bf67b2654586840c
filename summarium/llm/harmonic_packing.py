"""Harmonic packing of documents into sequences of a fixed number of tokens.

A document is the ids of its text and a closing id.  Pieces of a length in
(C / (k + 1), C / k] are of class k, and a sequence of class k holds exactly k of them, so
it needs no look at what other sequences hold: every worker numbers its own pieces of a
class, and a piece's sequence and place follow from that number.

Documents may be cut.  Whole sequences come off first; a rest whose k copies would leave
more than ``SLACK`` ids of padding gives up a piece of C div (k + 1) ids, the top of the
next class, and what is left (less than C / (k (k + 1)) ids) is looked at again.  So every
full sequence of class k holds C - ``SLACK`` ids or more, whatever the lengths are, and a
document of fewer than C ids makes few pieces.

1. Tokens.  Tasks tokenise texts, cut them and number the pieces by class; the pieces
   (not their ids) are staged in the shared folder, so that the numbers hold whatever
   executors are lost later.
2. Numbers.  The counts of (task, class) are summed up by class over the tasks; piece i of
   a class goes to its sequence i div k.
3. Offsets are running sums within a sequence.
4. The pieces beyond the last full sequence of each class, at most k - 1 of class k (by
   the lengths that exist for 2,048 ids, below 10,200 in all, whatever the corpus), are
   packed best-fit decreasing by one task.

Tokenising goes by chunks between ASCII white space: the tokenizer must split there and
its normalisation must not reach across (as for word-level pre-tokenizers that drop white
space), so a text's ids are its chunks' ids in a row.  A worker keeps the ids of
``CHUNKS`` to twice as many chunks.  A text is lower-cased before the look-up where the
tokenizer lower-cases and no code point is U+0300 or beyond (below, no marks combine and
letters are lower-cased one by one).

Scale: the texts are read once and never shuffled; what is shuffled is a narrow row a
piece, by sequence.  A hot source or a group of copies is rows like others.

Defined cases: a null or empty text is the closing id alone; a null id stays null; rows
with the same id are documents of their own; very long texts are cut into whole sequences
and a rest; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, text_or_empty

CAPACITY = 2048
CLOSING_ID = 1
#: Ids of padding that a full sequence may have.
SLACK = 32
#: Chunks after which a worker begins to forget those of the time before (twice 60 MB).
CHUNKS = 300_000
#: Bytes of text that are tokenised together.
SLICE = 1 << 21

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "class int, task int, nth long")
_MARKS = re.compile(rb"[\xcc-\xff]")
#: Letters that fast chunks are made of, all in lower case: a to z and Latin-1 from U+00E0.
_PLAIN = "".join(map(chr, [*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0x100)]))
_WORD = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut_lengths(tokens: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document, in order."""
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        length = rest if capacity - k * rest <= slack else capacity // (k + 1)
        out.append((length, capacity // length))
        rest -= length
    return out


class ChunkIds:
    """Ids of texts as little-endian 32-bit words, by their chunks.

    A chunk of small letters (``_PLAIN``) and closing ASCII signs is the ids of the letters
    and of the signs, where the tokenizer keeps the two apart; letters that its
    normalisation leaves alone go to its merges at once."""

    def __init__(self, path: str, limit: int = CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        #: chunks in use, and those of the time before
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else None
        self.lower = normal("AZÀÞ") == "azàþ"
        self.apart = split is not None and normal(_PLAIN) == _PLAIN and len(split(_PLAIN + ".,")) == 2
        #: letters as the merges see them
        self.seen = {ord(c): split(c)[0][0] for c in _PLAIN} if self.apart else {}

    def chunks(self, raw: bytes) -> list[bytes]:
        return (raw.decode().lower().encode() if self.lower and not _MARKS.search(raw) else raw).split()

    def _encode(self, chunks: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        self.known.update((c, _little(e.ids)) for c, e in zip(chunks, found))

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) >= self.limit:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = chunks.difference(known)
        back = new.intersection(older)
        known.update((c, older[c]) for c in back)
        new -= back
        if not self.apart:
            return self._encode(list(new))
        found = {c: m.groups() for c in new if (m := _WORD.fullmatch(c))}
        signs = {s for _, s in found.values() if s}.difference(known)
        self._encode([*new.difference(found), *signs])
        merge = self.tokenizer.model.tokenize
        for stem in {x for x, _ in found.values()}.difference(known):
            word = stem.decode()
            known[stem] = _little([t.id for t in merge(word if stem.isascii() else word.translate(self.seen))])
        known.update((c, known[stem] + known[sign]) for c, (stem, sign) in found.items() if sign)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        parts = [self.chunks(t) for t in texts]
        self.learn(set().union(*parts))
        known = self.known.__getitem__
        return [b"".join(map(known, p)) for p in parts]


@lru_cache(maxsize=1)
def _chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def _cutting(path: str, capacity: int, slack: int, closing: int):
    tail = closing.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        nth: dict[int, int] = {}
        ids_of = _chunk_ids(path)

        def pieces(keys: list, texts: list[bytes]) -> pa.RecordBatch:
            rows = []
            for key, ids in zip(keys, ids_of.ids(texts)):
                ids += tail
                tokens = len(ids) // 4
                start = 0
                for length, k in cut_lengths(tokens, capacity, slack):
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    rows.append((key, start, length, crc, tokens, k, task, nth.get(k, 0)))
                    nth[k] = nth.get(k, 0) + 1
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "nth"]
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts: list[bytes] = []
            size = done = 0
            for text in batch.column(1).cast(pa.binary()):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= SLICE:
                    yield pieces(keys[done:done + len(texts)], texts)
                    done += len(texts)
                    texts, size = [], 0
            if texts:
                yield pieces(keys[done:], texts)
    return run


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of every length, largest first into the fullest bin that takes it."""
    room: list[tuple[int, int]] = []
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect.bisect_left(room, (lengths[i], -1))
        left, b = room.pop(at) if at < len(room) else (capacity, len(room))
        out[i] = b
        bisect.insort(room, (left - lengths[i], b))
    return out


def _leftovers(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["class", "i"], ignore_index=True)
        rows["sequence_id"] = rows["first"] + pd.Series(best_fit(rows["length"].tolist(), capacity))
        return rows.drop(columns="first")
    return run


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK,
                  closing: int = CLOSING_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with their class, task and number in both."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_cutting(tokenizer, capacity, slack, closing), _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK,
         closing: int = CLOSING_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class) of every
    piece.  ``tokenizer`` is the path of a tokenizer file that the workers can read."""
    pieces = staged(cut_documents(docs, tokenizer, capacity, slack, closing, key, text), "pieces")
    # a row for each task and class, then one a class
    of_class = W.partitionBy("class")
    before = of_class.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    held = pieces.groupBy("task", "class").agg(F.count("*").alias("held"))
    shares = staged(held.select("task", "class", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"),
                                F.floor(F.sum("held").over(of_class) / F.col("class")).alias("full")),
                    "piece-shares")
    classes = shares.groupBy("class").agg(F.first("full").alias("full"))
    # one row a class, at most ``capacity`` of them
    first = staged(classes.select("class", F.coalesce(
        F.sum("full").over(W.orderBy("class").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("first"), F.sum("full").over(W.partitionBy()).alias("all_full")), "piece-classes")
    numbered = (pieces.join(shares, ["task", "class"])
                      .join(F.broadcast(first), "class")
                      .withColumn("i", F.col("before") + F.col("nth"))
                      .withColumn("in_full", F.col("i") < F.col("full") * F.col("class")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "i"]
    whole = (numbered.where("in_full")
                     .select(*columns, (F.col("first") + F.floor(F.col("i") / F.col("class"))).alias("sequence_id")))
    # fewer than k pieces of each class k: one small group
    rest = numbered.where("not in_full").select(*columns, F.col("all_full").alias("first"))
    kinds = ", ".join(f"{c} {t}" for c, t in rest.dtypes[:-1]) + ", sequence_id long"
    packed = rest.groupBy().applyInPandas(_leftovers(capacity), kinds)
    place = W.partitionBy("sequence_id").orderBy("class", "i").rowsBetween(W.unboundedPreceding, -1)
    return (whole.unionByName(packed)
                 .withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0).cast("long")))
                 .select(*columns[:5], "sequence_id", "offset", "class"))
