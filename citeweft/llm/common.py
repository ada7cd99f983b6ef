"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: White space between words: blank and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast; exact names win, a missing column is null.

    Goes by position, so further columns may repeat a name or differ from one in case only.
    """
    names = df.columns
    plain = df.toDF(*(f"_c{i}" for i in range(len(names))))

    def one(name: str, kind: str) -> Column:
        if name in names:
            return F.col(f"_c{names.index(name)}").cast(kind).alias(name)
        return F.lit(None).cast(kind).alias(name)

    return plain.select(*(one(k, v) for k, v in kinds.items()))


def durable(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read again: cuts the lineage, survives lost executors, prunes columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeweft/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Deletes the files of a durable table that nothing reads any more."""
    where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
    where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Within, a job's shuffle files go as it ends, not when the driver's collector happens to find them unused.

    The session's setting is put back afterwards; a DataFrame that is executed twice shuffles twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose key hashes lowest; the same ones however the rows are spread.

    A bound on the hash, from the number of rows, keeps what the final limit has to gather near ``most``.
    """
    total = df.count()
    if total > 2 * most:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * most / total)))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none where it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches by bytes as well as by rows, so that very long texts do not add up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
