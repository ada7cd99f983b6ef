"""Connected components over the cluster, for clusters of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable, durable_counted


def clusters(pairs: DataFrame) -> DataFrame:
    """(key, rep) for each key in pairs (a, b): rep is the smallest key of the cluster.

    Each round links every key to the smallest representative in its neighbourhood, then follows links once more, so
    rounds grow with the logarithm of a cluster's width.
    """
    edges = durable(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct())
    labels = durable(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("rep")))
    changed = 1
    while changed:
        near = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("rep").alias("near"))
        lower = labels.join(near, "key").select("key", F.col("rep").alias("old"), F.least("rep", "near").alias("rep"))
        jump = labels.select(F.col("key").alias("rep"), F.col("rep").alias("further"))
        new = lower.join(jump, "rep", "left").select("key", "old", F.least("rep", "further").alias("rep"))
        new, changed = durable_counted(new, F.col("rep") != F.col("old"))
        labels = new.select("key", "rep")
    return labels
