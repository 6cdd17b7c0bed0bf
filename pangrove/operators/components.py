"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pangrove.plans.storage import discard, written


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A small table of ids, written plainly: compressing it would cost more memory than it saves disk."""
    return written(df, name, "uncompressed")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node of an edge between two nodes; the component is its least node.

    Large stars hand each node's least neighbour to its larger ones, small
    stars to its smaller ones, until no edge changes.  A hub's edges are never
    gathered: its least neighbour comes from a combined aggregate, and the join
    back to the edges is one that Spark splits where a hub is large.  Each
    round's tables are deleted when the next one's are written.
    """
    e = _kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct(), "component-edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that a join to a hub's edges can be split.
        least = _kept(both.groupBy("u").agg(F.min("v").alias("m")), "component-least")
        low = least.select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = _kept(pairs.where(F.col("u") != F.col("v")).distinct(), "component-edges")
        discard(e, least)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = e.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
