"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lower neighbours to the least of them. Edges are (higher u, lower v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its least node.

    Null end points and self loops add nothing but the node itself. Nodes of any ordered type work.
    Each round writes its edges to the shared folder, so lineage stays short and lost executors cost
    one round. A round never gathers a component in one task: hubs are reduced by partial ``min``.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    current = materialize(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components"
    )
    mark = None
    while True:
        before, current = current, materialize(_small_star(_large_star(current)), "components")
        discard(before)
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return nodes.join(current, nodes.node == current.u, "left").select("node", F.coalesce("v", "node").alias("component"))
