"""Connected components by alternating large-star and small-star steps.

Every step is a partially aggregated minimum per node and a join of two
shuffled tables, which Spark can split where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize


def _with_min(edges: DataFrame) -> DataFrame:
    """Each edge ``u, v`` with ``m``, the least neighbour of ``u``."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(bounded(least), "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that ``edges(u, v)`` names; ``root`` is the least node of its component.

    Loops and repeated edges are allowed, null ends are not.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        large = materialize(large)
        starred = _with_min(large)
        edges = materialize(starred.select("u", F.col("m").alias("v")).union(starred.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
