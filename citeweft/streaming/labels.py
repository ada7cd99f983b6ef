"""Label files as a stream: decisions reach a table as their files land, each key's latest one counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def label_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(key, decision, ts) of CSV files with a header as they land."""
    rows = spark.readStream.schema("key string, decision string, note string, ts timestamp").option("header", True).csv(folder)
    return rows.where("key <> '' and decision <> ''").select("key", F.lower("decision").alias("decision"), "ts")


def latest(stream: DataFrame) -> DataFrame:
    """Each key's latest decision; the state holds one row for each key."""
    return stream.groupBy("key").agg(F.max_by("decision", "ts").alias("decision"), F.max("ts").alias("ts"))


def rates(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Screened and included by event-time window; labels later than ``late`` are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return w.agg(F.count("*").alias("n_screened"), F.count_if(F.col("decision") == "include").alias("n_included")).select(F.col("w.start").alias("start"), "n_screened", "n_included")


def write_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table of latest decisions at ``path``, a whole new version for each batch of files."""

    def put(batch: DataFrame, version: int) -> None:
        batch.coalesce(8).write.mode("overwrite").parquet(f"{path}/v={version}")

    return latest(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
