"""Sequences of subword ids (I6, I8) with a given vocabulary.

The vocabulary is that of a public tokenizer, given by the path of its file; none is learned
here.  The file must be readable by every worker; each loads it once.  Texts are encoded row
by row in Arrow batches, so nothing is shuffled and no vocabulary table is joined.  Of a batch
``TOGETHER`` texts at a time stand as Python objects; their ids are 32-bit numbers.

``encode`` gives padded ids and their mask, ``labels`` with the padding replaced by the
ignored label, and the number of ids before truncation, as the whitespace vocabulary of
``shaping`` does.  Null texts are empty; very long texts are encoded whole and then cut to
``max_len`` (the count says by how much); texts are taken as they are, so a special token's
string in a text is ordinary text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shaping import LABEL_IGNORE, PAD_ID, truncate_chars
from ..functions.kernels import by_pieces
from ..functions.text import col_

#: Texts that go through the tokenizer together.
TOGETHER = 64


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # tasks are the parallelism
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = True
    return out


def encoded(path: str):
    """Kernel: texts -> ids."""
    def ids(texts: list) -> list[np.ndarray]:
        found = load_tokenizer(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    return lambda texts: by_pieces(ids, pa.list_(pa.int32()), texts, size=TOGETHER)


def decoded(path: str):
    """Kernel: ids -> texts."""
    def text(rows: list) -> list[str | None]:
        tokenizer = load_tokenizer(path)
        return [None if r is None else tokenizer.decode(r, skip_special_tokens=False) for r in rows]

    return lambda rows: by_pieces(text, pa.string(), rows, size=TOGETHER)


def subword_ids(text, path: str) -> Column:
    """All ids of a text, without special tokens."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return encoded(path)(texts)

    return ids(col_(text))


def subword_text(ids, path: str) -> Column:
    """The text that ids stand for."""
    @F.arrow_udf(T.StringType())
    def text(rows: pa.Array) -> pa.Array:
        return decoded(path)(rows)

    return text(col_(ids))


def encode_subwords(df: DataFrame, key: str, text: str, path: str, max_len: int,
                    max_chars: int | None = None, pad_id: int = PAD_ID, mask_labels: bool = False) -> DataFrame:
    """(key, n_subwords, input_ids, attention_mask[, labels])."""
    t = truncate_chars(text, max_chars) if max_chars else col_(text)
    whole = df.select(key, subword_ids(t, path).alias("_ids"))
    cut = whole.select(key, F.size("_ids").alias("n_subwords"), F.slice("_ids", 1, max_len).alias("_ids"))
    rest = F.lit(max_len) - F.size("_ids")
    labels = [F.concat("_ids", F.array_repeat(F.lit(LABEL_IGNORE), rest)).alias("labels")] if mask_labels else []
    return cut.select(key, "n_subwords", F.concat("_ids", F.array_repeat(F.lit(pad_id), rest)).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), rest))
                      .alias("attention_mask"), *labels)
