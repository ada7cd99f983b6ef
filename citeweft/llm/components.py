"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node that can be reached.

    Alternating large and small stars: in turn, each node's larger neighbours, then its smaller ones, are linked to
    the smallest of its neighbourhood, until nothing changes; the rounds grow with the logarithm of the nodes. Rounds
    are written to the shared folder. Nodes with many neighbours are pre-aggregated and joined back, so that they can
    be split. Loops and repeated edges are harmless; no edge gives no row.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before: tuple | None = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        now = durable(small)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v").distinct())
