"""Subword sequences: equal to the tokenizer, and back to the text."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from summarium.operators import subwords as SW

ODD = [(1, None), (2, ""), (3, " \n"), (4, "Ünï côdé 文字 \U0001f600"), (5, "<|endoftext|> is text"),
       (6, "word " * 20_000), (7, "same"), (7, "same")]


@pytest.mark.parametrize("name, exact", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoding_equals_the_tokenizer(spark, sf, name, exact):
    path = public_tokenizers.path(name)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    df = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).repartition(3)
    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    rows = df.select("text", SW.subword_ids("text", path).alias("ids")).withColumn(
        "back", SW.subword_text("ids", path)).collect()
    assert len(rows) == 68
    for r in rows:
        assert r.ids == tk.encode(r.text or "", add_special_tokens=False).ids
        if exact:
            assert r.back == (r.text or "")


def test_padding_masks_and_labels(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    e = SW.encode_subwords(df, "doc_id", "text", path, 8, mask_labels=True)
    for r in e.collect():
        kept = min(8, r.n_subwords)
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 8
        assert r.attention_mask == [1] * kept + [0] * (8 - kept)
        assert r.labels == r.input_ids[:kept] + [-100] * (8 - kept) and r.input_ids[kept:] == [0] * (8 - kept)
    assert SW.encode_subwords(df.where(F.lit(False)), "doc_id", "text", path, 8).count() == 0
    short = SW.encode_subwords(df, "doc_id", "text", path, 8, max_chars=4).where("doc_id = 6").first()
    assert short.n_subwords == 1
