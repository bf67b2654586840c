"""Incremental, resumable scoring with Structured Streaming.

The ``predictions`` folder is the stream source; the checkpoint records which files were
consumed and holds the state: a stateful operator keyed by (system, article_id) lets each
pair through once, in whatever file, batch or run on the checkpoint it stands again.  A
batch is written under its own epoch number and overwrites it, and the state of an epoch is
committed after its batch, so a batch that is retried after a failure meets the state as it
was and replaces what it wrote: every pair is scored exactly once, and the scores are never
read back.  Pairs that were scored elsewhere may be given as ``previous`` and are left out
by one anti join a batch.

Only what the scores are made of travels to the state: not the source, and of the model input
its preview.

State: one key a pair and no row content.  It lives in the session's state store provider;
``ROCKSDB`` keeps it on the executors' disks with its changes in the checkpoint, which a
corpus of many pairs needs.  ``forget_after`` bounds it in time: the watermark follows the
files' modification times, and a pair's key goes when the watermark has passed the pair's
file by that much.  Repeats that come later than that, or files older than the watermark,
are then no longer caught, as one has said by the bound.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PREVIEW_CHARS, truncate_chars
from ..operators.evaluate import resume_todo, score_predictions

PAIR = ["system", "article_id"]
SCORE_COLUMNS = [*PAIR, "status", "error", "run_id", "input_length", "padded_length", "seconds",
                 "rouge1", "rouge2", "rougeL"]
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scores_schema(spark: SparkSession, predictions_schema: T.StructType) -> T.StructType:
    empty = spark.createDataFrame([], predictions_schema)
    return score_predictions(empty).select(*SCORE_COLUMNS).schema


def read_scores(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def each_pair_once(stream: DataFrame, forget_after: str | None = None) -> DataFrame:
    """The rows of a stream whose pair no earlier row had; of the rows of a pair that come
    in one batch, one.  Null ids are ids like others."""
    if forget_after is None:
        return stream.dropDuplicates(PAIR)
    timed = stream.withColumn("_seen_at", F.col("_metadata.file_modification_time"))
    return (timed.withWatermark("_seen_at", forget_after)
                 .dropDuplicatesWithinWatermark(PAIR).drop("_seen_at"))


def scored_columns(stream: DataFrame) -> DataFrame:
    """The predictions without the texts that no score is made of."""
    return stream.withColumn("model_input", truncate_chars("model_input", PREVIEW_CHARS)).drop("source")


def score_stream(spark: SparkSession, predictions_path: str, scores_path: str,
                 checkpoint_path: str, max_files_per_trigger: int = 16,
                 use_stemmer: bool = True, previous: DataFrame | None = None,
                 forget_after: str | None = None) -> DataFrame:
    """Run the stream until the folder is drained (``availableNow``) and return the scores
    table, partitioned by checkpoint, epoch and system.

    A second run on the same checkpoint scores only pairs that are new.  Scores written
    under another checkpoint into the same table stay; hand them in as ``previous``."""
    pschema = spark.read.parquet(predictions_path).schema
    sschema = scores_schema(spark, pschema)
    # epochs count from 0 in every checkpoint, so each has a folder of its own
    base = f"{scores_path}/source={hashlib.md5(checkpoint_path.encode()).hexdigest()[:12]}"
    # an empty epoch, so that the table can be read before the first batch
    spark.createDataFrame([], sschema).write.mode("overwrite").partitionBy("system").parquet(f"{base}/epoch=-1")

    def batch(df: DataFrame, epoch_id: int) -> None:
        todo = df if previous is None else resume_todo(df, previous)
        new = score_predictions(todo.withColumn("run_id", F.lit(f"stream-{epoch_id}")),
                                use_stemmer=use_stemmer).select(*SCORE_COLUMNS)
        new.write.mode("overwrite").partitionBy("system").parquet(f"{base}/epoch={epoch_id}")

    stream = (spark.readStream.schema(pschema)
                   .option("maxFilesPerTrigger", max_files_per_trigger)
                   .parquet(predictions_path))
    query = (each_pair_once(scored_columns(stream), forget_after).writeStream.foreachBatch(batch)
             .option("checkpointLocation", checkpoint_path)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return read_scores(spark, scores_path, sschema)
