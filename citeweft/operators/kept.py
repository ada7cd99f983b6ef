"""Clusters that are kept up to date: new pairs join what is there, and only what changes is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable, shared_dir
from .graph import clusters

#: Parts of the table; a key's part never changes.
PARTS = 64


class Clusters:
    """(key, rep) of all keys in the pairs so far, in a table of ``parts`` parts by the hash of the key.

    A batch of pairs is contracted first: each end is replaced by its representative. What is left between different
    representatives is a small graph, whose components tell which representatives give way to which. Keys of those, and
    keys that are new, are written, by overwriting the parts that hold them; other parts are not touched, and a batch that
    merges nothing writes nothing. The representative is the smallest key of a cluster. Pairs with a null end are left out.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = PARTS, kind: str = "string"):
        self.spark, self.parts = spark, parts
        self.path = path or f"{shared_dir(spark)}/citeweft/{uuid.uuid4().hex}"
        self.ddl = f"key {kind}, rep {kind}, part int"
        self.there = False

    def read(self) -> DataFrame:
        """(key, rep)."""
        return self._rows().select("key", "rep")

    def _rows(self) -> DataFrame:
        if not self.there:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(self.path)

    def add(self, pairs: DataFrame) -> int:
        """Takes pairs (a, b); how many keys have another representative than before, new ones included."""
        kept = self._rows()
        ends = pairs.where("a is not null and b is not null and a <> b").select("a", "b")
        name = lambda df, c: df.join(kept.select(F.col("key").alias(c), F.col("rep").alias(f"{c}_rep")), c, "left")
        # a key that is known already gives its representative, a new one itself
        named = durable(name(name(ends, "a"), "b").select("a", "b", F.coalesce("a_rep", "a").alias("x"), F.coalesce("b_rep", "b").alias("y")))
        open_ = named.where("x <> y")
        if open_.isEmpty():
            return 0
        moved = durable(clusters(open_.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        old = kept.join(moved.select(F.col("key").alias("rep"), F.col("rep").alias("to")), "rep").where("rep <> to").select("key", F.col("to").alias("rep"))
        ones = moved.join(kept.select("key"), "key", "left_anti").select("key", "rep")
        part = F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")
        changed = durable(old.union(ones).withColumn("part", part))
        touched = [r.part for r in changed.select("part").distinct().collect()]  # at most ``parts``
        same = kept.where(F.col("part").isin(touched)).join(changed.select("key"), "key", "left_anti").select("key", "rep", "part")
        changed.union(same).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        self.there = True
        return changed.count()
