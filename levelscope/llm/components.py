"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _least(down)
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches) of every node with an edge.

    ``edges`` has long columns u and v. Each round's edges are written to the shared folder, and
    the round's before are removed; rounds grow with the logarithm of the number of nodes. A node
    with very many neighbours is the skewed side of a join whose other side has a row a node, which
    Spark's adaptive execution splits. Repeated edges count once, edges from a node to itself and
    edges with a null not at all; without edges there are no rows.
    """
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        old, edges = edges, written(small_star(large_star(edges)), "edges")
        drop_written(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = written(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
    drop_written(edges)
    return out
