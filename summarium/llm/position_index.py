"""Spelling variants by a bit-sliced position index.

Words are near when they differ by exactly one inserted, deleted or replaced letter.  For
every (position, letter) the index holds a bitset over the words of a block that bear the
letter there.  A query word runs through its letters once and keeps, as bitsets over the
block, the words that agree so far with no error and those that agree with one:

    replaced    S = (S & B[i]) | (Z & ~B[i])
    one letter more in the word    I = (I | Z) & B[i + 1]
    one letter less in the word    D = (D & B[i - 1]) | Z
    no error    Z = Z & B[i]

with B[i] the bitset of (i, letter i of the query) and B[i + 1], B[i - 1] the shifted
positions; 64 words go through each operation.  The words of a block stand in the order
of falling count, so the lowest set bit of a result is the most frequent near word and the
number of set bits is how many there are: no pair leaves a task.

1. Count.  One pass over the texts counts the runs of letters inside each task (and
   deletes the letter that the seeded slip names), then by word.
2. Blocks.  Of two near words of m and m or m + 1 letters either the first m div 2 letters
   are equal or the last m - m div 2 (one error can't touch both halves).  So every word
   stands, for its own m and for m - 1, in a bucket by its first and in one by its last
   letters.  A pair of both buckets counts in the first one: there the zero-error set
   after the first half says so.  Buckets are laid out in sorted order and swept into
   blocks of about ``BLOCK`` words with a mask of each word's bucket; one of more words is
   cut by a hash into chunks, whose pairs are searched on their own.
3. The best near word of a word gives its form; roots come by pointer doubling, whose
   rounds grow with the logarithm of the longest chain (at most log5 of the largest count).

Scale: texts are read once; a task hands on its counts at ``TALLY_WORDS`` words, so a
frequent word is one row a task.  A vocabulary word makes four bucket rows; a block holds
at most three times ``BLOCK`` words, for which a set is some kilobytes a query, and ``QUERIES``
words of it are searched at a time, so a task holds no set for every word of a block.

Defined cases: a null text has no words; a null id is the empty string in the seeded slip;
only ASCII A-Z is lower-cased; letters beyond U+00FF end a run; repeated rows count each;
runs and texts of any length are taken whole; ties go to the word of smaller code points;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 5
#: One (document, run) of so many has a letter deleted.
SLIP = 199
#: Words of a block of the index.
BLOCK = 4096
#: Query words of a block that run through the index together.
QUERIES = 512
#: Words that a task counts before it hands them on (some 40 MB).
TALLY_WORDS = 300_000

#: Byte table over Latin-1: letters (A-Z in lower case, U+00C0 to U+00FF) or a space.
_LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32
                      for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Runs of letters of a text, lower-cased, in Latin-1 (a byte a code point)."""
    # what Latin-1 lacks becomes "?", which ends a run as any other sign does
    return text.encode("latin-1", "replace").translate(_LETTER_BYTES).split()


def slipped(run: bytes, doc_crc: int, slip: int = SLIP) -> bytes:
    """The run, without the letter that its hash names if ``slip`` divides the hash.
    ``doc_crc`` is the crc32 of the document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc_crc)
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counting(min_letters: int, slip: int):
    def table(counts: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()),
                                           pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                crc = zlib.crc32(f"{key}:".encode())
                # a slip only shortens, so shorter runs can't become words
                words = [w for w in runs_of(text) if len(w) >= min_letters]
                counts.update(words)
                for w in set(words):
                    got = slipped(w, crc, slip)
                    if got is not w:
                        n = words.count(w)
                        counts[w] -= n
                        if not counts[w]:
                            del counts[w]
                        if len(got) >= min_letters:
                            counts[got] += n
                if len(counts) >= TALLY_WORDS:
                    yield table(counts)
                    counts.clear()
        if counts:
            yield table(counts)
    return run


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
               slip: int = SLIP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of every word of enough letters and occurrences."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
                       F.col(text).alias("text"))
    return (rows.mapInArrow(_counting(min_letters, slip), "word string, n long")
                .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _letters(words: list[str], width: int) -> np.ndarray:
    """(word, position) codes, 0 beyond a word's end."""
    out = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        raw = np.frombuffer(w.encode("latin-1"), np.uint8)
        out[i, :len(raw)] = raw
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans to rows of 64-bit words, lowest bit first."""
    pad = -bits.shape[-1] % 64
    if pad:
        bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def near_in_block(words: list[str], m: int, half: int | None, targets: np.ndarray) -> np.ndarray:
    """Bitset of the near words of every word of a block of words of m and m + 1 letters:
    pairs of m and m, and of m and m + 1 letters.

    ``targets`` are the bitsets of the words that a word may meet.  ``half``, unless None,
    leaves out the pairs whose first ``half`` letters are equal."""
    return _near(*_slots(words, m), m, half, targets, slice(0, len(words)))


def _slots(words: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a block (0: beyond a word's end), and their numbers by word and position."""
    codes = _letters(words, m + 2)
    known, slot = np.unique(codes, return_inverse=True)
    return known, slot.reshape(codes.shape)


def _near(known: np.ndarray, slot: np.ndarray, m: int, half: int | None, targets: np.ndarray,
          queries: slice) -> np.ndarray:
    """``near_in_block`` of some words of the block, whose ``targets`` are given."""
    n_words = len(slot)
    all_longer = known[slot[:, m]] != 0
    longer = all_longer[queries]

    def position(i: int) -> np.ndarray:
        """The bitset of (i, letter) for every letter of the block."""
        bits = np.zeros((len(known), n_words), bool)
        bits[slot[:, i], np.arange(n_words)] = True
        bits[known == 0] = False
        return _packed(bits)

    zero = np.full(targets.shape, ~np.uint64(0), np.uint64)
    replaced = np.zeros_like(zero)
    more = np.zeros_like(zero)
    less = np.zeros_like(zero)
    prefix = None
    last, here, ahead = None, position(0), position(1)
    for i in range(m + 1):
        letter = slot[queries, i]
        b = here[letter]
        if i < m:                       # the queries of m letters end here
            more = (more | zero) & ahead[letter]
            replaced = (replaced & b) | (zero & ~b)
        if i:
            less &= last[letter]
        less |= zero
        if i == m:
            break
        zero &= b
        if half is not None and i + 1 == half:
            prefix = zero.copy()
        last, here, ahead = here, ahead, position(min(i + 2, m + 1))
    more |= zero
    short_set, long_set = _packed(~all_longer), _packed(all_longer)
    near = np.where(longer[:, None], less & short_set, (replaced & short_set) | (more & long_set))
    if prefix is not None:
        near &= ~prefix
    return near & targets


def _block_rows(m: int, side: int, rows: list[tuple]) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words of a block with near words in it.
    ``rows`` hold (word, n, segment, met segment)."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    segment = np.array([r[2] for r in rows])
    met = np.array([r[3] for r in rows])
    known, slot = _slots([r[0] for r in rows], m)
    counts, places, bests = [], [], []
    for lo in range(0, len(rows), QUERIES):
        queries = slice(lo, min(lo + QUERIES, len(rows)))
        # a chunk of a bucket may meet one that is empty
        targets = _packed(met[queries, None] == segment[None, :])
        near = _near(known, slot, m, m // 2 if side else None, targets, queries)
        n_near = np.bitwise_count(near).sum(1).astype(np.int64)
        found = np.flatnonzero(n_near)
        block = (near[found] != 0).argmax(1)
        low = near[found, block]
        low = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        counts.append(n_near[found])
        places.append(lo + found)
        bests.append(block * 64 + low)
    found, best = np.concatenate(places), np.concatenate(bests)
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[i][0] for i in found], pa.string()), pa.array(np.concatenate(counts)),
         pa.array([rows[i][1] for i in best], pa.int64()),
         pa.array([rows[i][0] for i in best], pa.string())],
        names=["word", "n_near", "best_n", "best"])


def _searching(block: int):
    """Sweep sorted bucket rows (m, side, piece, ci, cj, chunk, word, n) into blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kind = bucket = None
        segment = 0
        for batch in batches:
            for m, side, piece, ci, cj, chunk, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (piece, ci, cj) != bucket or (m, side) != kind:
                    if rows and ((m, side) != kind or len(rows) >= block):
                        yield _block_rows(*kind, rows)
                        rows, segment = [], 0
                    kind, bucket = (m, side), (piece, ci, cj)
                    segment += 2
                # two chunks of a bucket meet each other, a whole one meets itself
                first = chunk == ci
                rows.append((word, n, segment + (not first), segment + (first and ci != cj)))
        if rows:
            yield _block_rows(*kind, rows)
    return run


def _buckets(word: Column) -> Column:
    """The (m, side, piece) buckets of a word."""
    size = F.length(word)

    def pair(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.struct(m.alias("m"), F.lit(0).alias("side"), F.substring(word, F.lit(1), half).alias("piece")),
                F.struct(m.alias("m"), F.lit(1).alias("side"), F.right(word, m - half).alias("piece"))]
    return F.array(*pair(size), *pair(size - 1))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of every word of (word, n) that has a near word: how
    many there are and the one of largest n."""
    rows = words.select("word", "n", F.explode(_buckets(F.col("word"))).alias("b")).select("word", "n", "b.*")
    sizes = staged(rows.groupBy("m", "side", "piece").agg(F.count("*").alias("held"))
                       .where("held > 1"), "letter-buckets")
    chunks = F.ceil(F.col("held") / block).cast("int")
    cut = (rows.join(sizes, ["m", "side", "piece"])
               .withColumn("chunk", F.pmod(F.xxhash64("word"), chunks).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
               .select("m", "side", "piece", F.least("chunk", "other").alias("ci"),
                       F.greatest("chunk", "other").alias("cj"), "chunk", "word", "n"))
    key = ["m", "side", "piece", "ci", "cj"]
    found = (cut.repartition(*key).sortWithinPartitions(*key)
                .mapInArrow(_searching(block), "word string, n_near long, best_n long, best string"))
    return (found.groupBy("word")
                 .agg(F.sum("n_near").alias("n_near"),
                      F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b"))
                 .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of (word, form), following forms to the last one."""
    now = staged(forms.select("word", F.col("form").alias("root")), "form-roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        nxt = staged(now.join(ahead, F.col("root") == F.col("at"), "left")
                        .select("word", F.coalesce("further", "root").alias("root"),
                                F.col("further").isNotNull().alias("moved")), "form-roots")
        now = nxt.select("word", "root")
        if not nxt.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                      slip: int = SLIP, key: str = "doc_id", text: str = "text",
                      block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = staged(vocabulary(docs, min_letters, min_count, slip, key, text), "words")
    near = words.join(near_words(words, block), "word", "left")
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    formed = staged(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n",
                                F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                F.when(is_form, F.col("best_n")).alias("form_n")), "word-forms")
    last = roots(formed.where(F.col("form").isNotNull()))
    return (formed.join(last, "word", "left")
                  .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
