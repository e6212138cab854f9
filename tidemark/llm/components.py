"""Connected components of a graph of links, as joins and groupings.

Alternating large-star and small-star steps: every step points the neighbours
of a node at the smallest of them, so that long chains shorten by a factor each
time and each component ends as a star around its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node.

    Null ends and links of a node with itself join nothing; repeated links
    count once; no links give no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges, path = written(edges, "links")
    before = None
    while True:
        large = _star(edges.union(edges.select("v", "u")).toDF("u", "v"), "v > u")
        small = _star(large, None)
        found, new_path = written(small, "links")
        # Stars are a fixed point of both steps; equal sums of equal many links show it.
        state = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        edges, path = found, new_path
        if tuple(state) == before:
            break
        before = tuple(state)
    # a component id for the members, and for the centres themselves
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _star(edges: DataFrame, only: str | None) -> DataFrame:
    """Large-star of links both ways (``only``: neighbours above the node), or small-star of links downwards."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    near = edges.join(least, "u")
    if only:
        return near.where(only).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m")).distinct()
