"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collinear, harmonic_packing, html_mincut, level_products, license_votes,
               ngram_join, nra_topk, poisson_mix, position_index, quality_fm, secret_lex, spaced_seeds, sql, virtual_slots)
from .common import read_table, ready
from ..session import ensure_checkpoint_dir

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = dict(sql.ORACLES)
SHARDS = 8


def query(name: str):
    def add(fn: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)
        build.__name__, build.__doc__ = name, fn.__doc__
        QUERIES[name] = build
        return fn
    return add


@query("op1_quality_fm")
def op1(spark, sf_dir):
    """Quality score of every document, fitted outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    machine = quality_fm.fit(docs, read_table(spark, sf_dir, "labels"))
    score = quality_fm.score_documents(docs, machine)
    return (docs.select("doc_id", quality_fm.held_out().alias("held_out"), score.alias("score"))
                .withColumn("predicted", (F.col("score") >= quality_fm.THRESHOLD).cast("int")))


@query("op2_ngram_join")
def op2(spark, sf_dir):
    """Jaccard links of 4-word shingle sets, as components."""
    return ngram_join.linked_documents(read_table(spark, sf_dir, "documents"), percent=85, k=4)


@query("op3_html_mincut")
def op3(spark, sf_dir):
    """Main text of every page."""
    return html_mincut.extract_pages(read_table(spark, sf_dir, "pages"))


@query("op4_virtual_slots")
def op4(spark, sf_dir):
    """All documents in eight shards of near equal bytes, over 4,096 slots."""
    docs = virtual_slots.slotted(read_table(spark, sf_dir, "documents"))
    stats = virtual_slots.slot_stats(docs)
    path = f"{ensure_checkpoint_dir(spark)}/staged/slot-map-{uuid.uuid4().hex}"
    out = virtual_slots.positions(docs, virtual_slots.stored_map(spark, stats, SHARDS, path), stats)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op5_spaced_seeds")
def op5(spark, sf_dir):
    """Documents that hold a benchmark passage, with the item."""
    return spaced_seeds.contaminated(read_table(spark, sf_dir, "documents"),
                                     read_table(spark, sf_dir, "benchmark"))


@query("op6_poisson_mix")
def op6(spark, sf_dir):
    """The corpus replicated to smoothed source weights, in global random order."""
    return poisson_mix.mix(read_table(spark, sf_dir, "documents"))


@query("op7_collinear")
def op7(spark, sf_dir):
    """Passages of 50 words and more that another document repeats."""
    return collinear.shared_passages(read_table(spark, sf_dir, "documents"))


@query("op8_secret_lex")
def op8(spark, sf_dir):
    """Secrets of every document: base patterns and literals of sensitive names."""
    return secret_lex.scan_documents(read_table(spark, sf_dir, "documents"))


@query("op9_license_votes")
def op9(spark, sf_dir):
    """License phrases and notices of every document."""
    return license_votes.scan_documents(read_table(spark, sf_dir, "documents"))


@query("op10_nra_topk")
def op10(spark, sf_dir):
    """The five best inner products for every fiftieth vector."""
    return nra_topk.top_k(read_table(spark, sf_dir, "embeddings"))


@query("op11_level_products")
def op11(spark, sf_dir):
    """Divergence of the sources of each language, and the terms that mark a source."""
    return level_products.divergence(read_table(spark, sf_dir, "documents"))


@query("op12_harmonic_packing")
def op12(spark, sf_dir):
    """All documents as pieces of sequences of 2,048 tokens."""
    import public_tokenizers

    return harmonic_packing.pack(read_table(spark, sf_dir, "documents"),
                                 public_tokenizers.path("word_bpe_49k.json"))


@query("op13_position_index")
def op13(spark, sf_dir):
    """Words of the corpus with their near words, forms and roots."""
    return position_index.spelling_variants(read_table(spark, sf_dir, "documents"))
