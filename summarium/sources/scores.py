"""Score files of drifting shape (S2, A8): read as VARIANT, by paths tried in order.

Runs of different age name their figures differently (``rouge1_mean``, ``rouge1``,
``results.rouge1.mean``), leave some out and add others.  Every file is one VARIANT value;
a field is the first of its paths that holds a value of its type, and top-level fields that
no path names are kept as JSON and listed, so that nothing a file says is lost.

A file is read whole (score files are small), files are spread over tasks by Spark.  A file
that is no JSON object gives a row with ``valid`` false and null fields; an empty folder
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_METRICS = ("rouge1", "rouge2", "rougeL")
#: Field: type and paths, the newest first.
SCORE_PATHS: dict[str, tuple[str, list[str]]] = {
    "model_name": ("string", ["$.model_name", "$.model", "$.name"]),
    "model_id": ("string", ["$.model_id", "$.checkpoint"]),
    "evaluation_date": ("string", ["$.evaluation_date", "$.date"]),
    "total_samples": ("bigint", ["$.total_samples", "$.samples_evaluated", "$.samples"]),
    "successful_samples": ("bigint", ["$.successful_samples", "$.samples_evaluated", "$.samples"]),
    "failed_samples": ("bigint", ["$.failed_samples"]),
    "success_rate": ("double", ["$.success_rate"]),
    **{f"{m}_mean": ("double", [f"$.{m}_mean", f"$.{m}", f"$.results.{m}.mean"]) for m in _METRICS},
    **{f"{m}_std": ("double", [f"$.{m}_std", f"$.results.{m}.std"]) for m in _METRICS},
    "evaluation_time_seconds": ("double", ["$.evaluation_time_seconds", "$.time_seconds"]),
}


def score_field(value: str, kind: str, paths: list[str]) -> Column:
    """The first path with a value of the type (numbers written as text count)."""
    return F.coalesce(*[F.try_variant_get(F.col(value), p, kind) for p in paths])


def read_score_variants(spark: SparkSession, path: str, fields: dict | None = None) -> DataFrame:
    """One row for each file under a path or glob: the fields, ``unknown`` (names of the
    other top-level fields, sorted), ``extra`` (these as JSON), ``valid`` and ``path``."""
    fields = fields or SCORE_PATHS
    known = sorted({p.removeprefix("$.").split(".")[0] for _, paths in fields.values() for p in paths})
    raw = (spark.read.text(path, wholetext=True)
                .select(F.try_parse_json("value").alias("_v"), F.col("_metadata.file_path").alias("path")))
    top = F.try_variant_get("_v", "$", "map<string,variant>")
    rest = F.map_filter(top, lambda k, _: ~k.isin(known))
    return raw.select(
        *[score_field("_v", kind, paths).alias(name) for name, (kind, paths) in fields.items()],
        F.array_sort(F.map_keys(rest)).alias("unknown"),
        F.to_json(rest).alias("extra"), top.isNotNull().alias("valid"), "path")
