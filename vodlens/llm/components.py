"""Connected components of a link table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.llm.common import drop_stored, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) of every node that the links (a, b) name.

    Each round is two aggregations and two joins over the links that remain, each written to the
    shared folder; nothing but two sums reaches the driver. Rounds grow with the logarithm of a
    component's width, and a hot node is a skewed join key, which adaptive execution splits.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is linked to the smallest node around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node's smaller neighbours, and the node, are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        fresh = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        drop_stored(edges)
        edges = fresh
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("the links did not settle; raise max_rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
