"""Connected components by alternating stars, as joins and aggregations.

Every round replaces edges by edges to smaller neighbours until each component is one star around
its smallest node. No node list, edge list or label ever reaches the driver; only one yes or no a
round does. A node with very many edges is pre-aggregated (``min``) before the shuffle, and the
joins that carry its edges are plain inner joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    bad = (
        ends.groupBy("x")
        .agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
        .where("c > 1 OR (c = 1 AND p = 1)")
    )
    return bad.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that ``edges`` joins to another; component is its smallest node.

    Edges with a null end and loops are left out. No edges give an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    pairs = edges.where(x.isNotNull() & y.isNotNull() & (x != y))
    pairs = pairs.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    current = materialize(pairs, "edges")
    while not _is_star_forest(current):
        current = materialize(_small_star(_large_star(current)), "stars")
    parents = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(parents)
