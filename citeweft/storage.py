"""Tables that cut a lineage: written once to the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="citeweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Writes a DataFrame and reads it again; loops stay flat and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeweft/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def durable_counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """As ``durable``, with the number of rows, or of those for which ``what`` holds, counted as they are written."""
    seen = Observation()
    out = durable(df.observe(seen, (F.count(F.lit(1)) if what is None else F.count_if(what)).alias("n")))
    return out, int(seen.get["n"])


#: Rows of one task where keys meet in memory.
DEAL = 200_000


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The rows dealt by the hash of some columns, to as many tasks as about ``rows`` of them need, at least as a shuffle's.

    Aggregates and joins on these columns go on from there without an exchange, and what one task holds does not grow with
    the input.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // DEAL)), *columns)


class Bucketed:
    """A table in the shared folder whose rows lie in buckets by the hash of some columns, as a shuffle would deal them.

    A join or an aggregate on these columns reads it without an exchange. The name in the session's catalog goes with
    ``close``, the files stay until the driver exits, as those of ``durable``.
    """

    def __init__(self, df: DataFrame, *columns: str):
        self.spark = df.sparkSession
        tag = uuid.uuid4().hex
        self.name, self.path = f"citeweft_{tag}", f"{shared_dir(self.spark)}/citeweft/{tag}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a task has the rows of one bucket, so that there is one file for each
        df.repartition(n, *columns).write.format("parquet").bucketBy(n, *columns).option("path", self.path).saveAsTable(self.name)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(where)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """The rows, as a plain table."""
        out = self.spark.read.schema(self.read().schema).parquet(self.path)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return out
