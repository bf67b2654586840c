"""Connected components over an edge table, as Spark joins.

Large-star and small-star rounds alternate until the edges no longer change; every
round is staged in the shared folder.  Nothing but two numbers a round (a count and a
hash of the edges) reaches the driver.  A node with very many neighbours is one row a
task in the aggregation; its edges meet its smallest neighbour by broadcast, where they
are, as long as such nodes are few, and else in a join of two staged tables, which adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Edges from which a node is joined by broadcast, and up to how many such nodes (16 MB).
HUB, HUBS = 1_000, 1_000_000


def _with_least(edges: DataFrame, to: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m``, the smallest neighbour of u in ``to`` or u itself."""
    least = staged(to.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
                     .select("u", F.least("u", "m").alias("m"), "n"), "least")
    hubs = least.where(F.col("n") > HUB).select("u", "m")
    if not 0 < hubs.count() <= HUBS:
        return edges.join(least.select("u", "m"), "u")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return (rest.join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
                .unionByName(edges.join(F.broadcast(hubs), "u")))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not its component's
    smallest node; ``root`` is that smallest node.  Nodes are longs."""
    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct(), "edges")
    before = _signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_with_least(both, both).where("v > u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        near = _with_least(large, large)
        small = (near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(near.where("v = m").select("u", F.col("m").alias("v"))))
        e = staged(small.distinct(), "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
