"""Kernels hold a few rows of a batch as Python objects, and give what they gave by rows."""

import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from summarium.functions import kernels as K
from summarium.functions.lexicon import ENTITY_TOKEN
from summarium.functions.stem import stem_tokens
from summarium.operators import subwords as SW

ROWS, WORDS = 4000, 200
TOKENS = [f"w{(i * 7919) % 100_003}" for i in range(WORDS)]


def token_column(rows=ROWS):
    return pa.array([TOKENS] * rows, pa.list_(pa.string()))


def peak(kernel, *columns):
    kernel(*[c.slice(0, 2) for c in columns])       # what is loaded once
    tracemalloc.start()
    try:
        out = kernel(*columns)
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def whole(column):
    """Bytes that a column takes when all its values stand as Python objects."""
    tracemalloc.start()
    try:
        held = column.to_pylist()
        return tracemalloc.get_traced_memory()[0] + 0 * len(held)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kernel, sides", [
    (K.rouge_counts_udf((1, 2), False).func, 2), (K.tf_cosine_udf.func, 2), (stem_tokens.func, 1)])
def test_token_kernels_hold_a_piece_of_a_batch(kernel, sides):
    column = token_column()
    out, held = peak(kernel, *[column] * sides)
    assert len(out) == ROWS and held < sides * whole(column) / 4


def test_text_kernels_hold_a_piece_of_a_batch():
    texts = pa.array([" ".join(TOKENS)] * ROWS)
    mentions, held = peak(K.gazetteer_udf({"w0": ["X"]}, 1, ENTITY_TOKEN, False).func, texts)
    assert mentions[ROWS - 1].as_py() == [{"ent_type": "X", "ent_text": "w0"}] and held < whole(texts) / 4


def test_subwords_hold_a_piece_of_a_batch():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = pa.array([" ".join(TOKENS)] * 1000)
    ids, held = peak(SW.encoded(path), texts)
    every = whole(ids)
    assert len(ids) == 1000 and held < every / 4
    back, held = peak(SW.decoded(path), ids)
    assert back.to_pylist() == texts.to_pylist() and held < every / 4


def test_pieces_keep_nulls_empty_rows_and_slices():
    rows = [["a", None], None, [], ["b"], ["c", "d"]]
    column = pa.array([["x"]] + rows, pa.list_(pa.string())).slice(1)
    for size in (1, 2, 9):
        got = K.by_pieces(lambda part: part, column.type, column, size=size)
        assert got.to_pylist() == rows
    assert len(K.by_pieces(lambda part: part, pa.string(), pa.array([], pa.string()))) == 0
    numbers = pa.array([[1, 2], [], None], pa.list_(pa.int32()))
    assert K.as_lists(numbers) == [[1, 2], [], None]


def test_rouge_and_cosine_of_odd_rows():
    a = pa.array([["x", "y"], None, [], ["x"]], pa.list_(pa.string()))
    b = pa.array([["x", "z"], ["x"], ["x"], None], pa.list_(pa.string()))
    assert K.rouge_counts_udf().func(a, b).to_pylist() == [
        {"o1": 1, "o2": 0, "lcs": 1}, {"o1": None, "o2": None, "lcs": None}, {"o1": 0, "o2": 0, "lcs": 0},
        {"o1": None, "o2": None, "lcs": None}]
    got = K.tf_cosine_udf.func(a, b).to_pylist()
    assert abs(got[0] - 0.5) < 1e-12 and got[1:] == [None, 0.0, None]
