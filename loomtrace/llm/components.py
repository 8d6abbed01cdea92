"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.storage import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins every node's neighbours to the smallest of them; ``large``: only neighbours above the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of (u, v) edges; a component is named by its smallest node.

    Nodes with a null end or only a self-loop are left out. Every round is written to the shared
    folder, so that the plan stays short and a lost executor repeats one round at most.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = materialise(ordered, "edges")
    seen = _fingerprint(current)
    while True:
        stars = _star(current, large=True).where("u <> v").distinct()
        downward = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        current = materialise(_star(downward, large=False).where("u <> v").distinct(), "edges")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
