"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import cut, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an undirected graph: root is the smallest node of its component.

    Large-star and small-star steps alternate until the edges stay as they are; each step is joins and map-side
    minima, so that a node with very many neighbours is never gathered in one task. Every round is checkpointed.
    Loops, nulls and repeated edges are ignored; no edges give no nodes.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = cut(e)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        former, e = e, cut(small)
        release(former)
        mark = F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1).cast("bigint")))
        state = e.agg(F.count("*"), mark).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
