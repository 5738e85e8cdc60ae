"""Connected components of a large graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; ``edges`` has columns a, b in any order.

    Large star: a node's greater neighbours are linked to its smallest one. Small star: a node and its smaller neighbours
    are. Each round halves paths; rounds end when the edges stay as they are. Each round's edges are a written table, so
    a lost executor costs one round at most. Minima are aggregated before the shuffle; a node of very high degree is
    split by the join, not gathered.
    """
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # these minima are written before they are joined: joined straight from their aggregation, a hot node could not be split
        least = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        linked = large.join(least.hint("merge"), "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        done, now = now, scratch.put(small, "edges")
        scratch.drop(done)
