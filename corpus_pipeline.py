"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read
again as the documents of the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  Null ids and texts, empty texts, repeated rows, empty
tables and extra columns pass as the operators' modules define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from summarium.llm import ngram_join, poisson_mix, quality_fm, spaced_seeds, virtual_slots
from summarium.llm.common import read_table, ready, staged
from summarium.session import ensure_checkpoint_dir

SHARDS = 8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    machine = quality_fm.fit(docs, read_table(ready(spark), sf_dir, "labels"))
    return docs.where(quality_fm.score_documents(docs, machine) >= F.lit(quality_fm.THRESHOLD))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    ready(spark)
    return ngram_join.keep_one(docs)


def leave_out_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return spaced_seeds.decontaminate(docs, read_table(ready(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in random order."""
    ready(spark)
    return poisson_mix.mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their virtual slot and shard, by the newest version of the slot map
    that the stage stores in the shared folder."""
    path = f"{ensure_checkpoint_dir(ready(spark))}/staged/slot-map-{uuid.uuid4().hex}"
    slot_map = virtual_slots.stored_map(spark, virtual_slots.slot_stats(docs), SHARDS, path)
    return virtual_slots.assign(docs, slot_map)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", leave_out_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier's training and the links of near copies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is staged in the shared folder."""
    docs = read_table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
