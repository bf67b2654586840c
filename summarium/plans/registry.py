"""Registry of named queries: a Spark builder and, where SQL can express it,
the DuckDB oracle SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ensure_checkpoint_dir, ship_package
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        build.__name__ = build.__qualname__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from . import (q_corpus, q_evaluation, q_factuality, q_leaderboard,  # noqa: F401
                   q_losses, q_shaping, q_sources)
    return REGISTRY
