"""Pairs within blocks, dealt so that no task depends on how large a block is.

The pairs of a block are a triangle. A block with more than a tile's side of records is cut into m chunks by a hash of
the key, and its triangle into the m (m + 1) / 2 tiles of two chunks each; a smaller block is one tile. A record goes to
the tiles of its chunk alone, m of them, and a task fetches those of its tiles. The side comes from the number of all
pairs, so that there are some sixteen tiles for each partition where blocks are large: the pairs of one block are spread as
evenly as those of many.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

#: Tiles of each partition, the least and the largest side of a tile, and large blocks that are sent to every task.
TILES, SIDES, FEW = 16, (64, 2048), 100_000


def sizes(rows: DataFrame) -> DataFrame:
    """(block, n) of the blocks that hold a pair at all; partial counts meet, not records."""
    return rows.where("block is not null").groupBy("block").agg(F.count("*").alias("n")).where("n > 1")


def side(blocks: DataFrame, partitions: int) -> int:
    """Records on a tile's side for (block, n)."""
    pairs = blocks.agg(F.sum(F.expr("n * (n - 1D) / 2"))).first()[0] or 0
    return min(SIDES[1], max(SIDES[0], ceil(sqrt(pairs / (TILES * partitions)))))


def chunked(rows: DataFrame, key: str) -> DataFrame:
    """The rows that share a block with another, with ``chunk`` and the number ``chunks`` of their block."""
    spark = rows.sparkSession
    known = durable(sizes(rows))
    edge = side(known, int(spark.conf.get("spark.sql.shuffle.partitions")))
    large = known.where(F.col("n") > edge).select("block", F.ceil(F.col("n") / edge).cast("int").alias("chunks"))
    if large.count() <= FEW:  # their number is checked, so they may go to every task
        large = F.broadcast(large)
    out = rows.where("block is not null").join(large, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return out.withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))


def block_pairs(rows: DataFrame, key: str, columns: tuple[str, ...], test: Column | None = None) -> DataFrame:
    """block, a_* and b_* of all pairs of rows with one block, each once, the smaller key as a.

    rows (block, key, columns). ``test`` is a condition on a_* and b_* that holds either way round; it is part of the join,
    so that what fails never leaves it. Rows without block or key pair with nothing; rows that repeat a key do not pair
    with each other.
    """
    each = chunked(rows.where(F.col(key).isNotNull()).select("block", *columns), key)
    last = F.col("chunks") - 1
    x = each.select("block", "chunk", F.explode(F.sequence("chunk", last)).alias("other"), *(F.col(c).alias(f"a_{c}") for c in columns))
    y = each.select(F.col("block").alias("b_block"), F.explode(F.sequence(F.lit(0), "chunk")).alias("b_chunk"), F.col("chunk").alias("b_other"), *(F.col(c).alias(f"b_{c}") for c in columns))
    one = (F.col("chunk") < F.col("other")) & (F.col(f"a_{key}") != F.col(f"b_{key}")) | (F.col(f"a_{key}") < F.col(f"b_{key}"))
    on = (F.col("block") == F.col("b_block")) & (F.col("chunk") == F.col("b_chunk")) & (F.col("other") == F.col("b_other")) & one
    met = x.join(y, on if test is None else on & test)
    swap = F.col(f"a_{key}") > F.col(f"b_{key}")
    put = [F.when(swap, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for p, q in (("a", "b"), ("b", "a")) for c in columns]
    return met.select("block", *put)


def group_pairs(members: DataFrame, alike: DataFrame, columns: tuple[str, ...] = (), test: Column | None = None) -> DataFrame:
    """p_* and q_* of all pairs of records whose groups are alike, with alike's other columns; each pair once.

    members (gid, key, columns), alike (a, b, ...), where a group may stand with itself. Large groups are cut into chunks,
    and each two chunks are a tile; every pair is made in one tile and goes nowhere else. ``test`` is a condition on p_*
    and q_*, part of the join.
    """
    names = ("key", *columns)
    each = chunked(members.select(F.col("gid").alias("block"), *names), "key")
    cut = each.groupBy("block").agg(F.max("chunks").alias("chunks"))
    parts = lambda c, x: cut.select(F.col("block").alias(c), F.sequence(F.lit(0), F.col("chunks") - 1).alias(x))
    tiles = alike.join(parts("a", "x"), "a").join(parts("b", "y"), "b").withColumn("x", F.explode("x")).withColumn("y", F.explode("y"))
    tiles = tiles.where("a <> b or x <= y")
    p = tiles.join(each.select(F.col("block").alias("a"), F.col("chunk").alias("x"), *(F.col(c).alias(f"p_{c}") for c in names)), ["a", "x"])
    q = tiles.select("a", "b", "x", "y").join(each.select(F.col("block").alias("b"), F.col("chunk").alias("y"), *(F.col(c).alias(f"q_{c}") for c in names)), ["b", "y"])
    q = q.select(*(F.col(c).alias(f"to_{c}") for c in ("a", "b", "x", "y")), *(f"q_{c}" for c in names))
    one = F.when((F.col("a") == F.col("b")) & (F.col("x") == F.col("y")), F.col("p_key") < F.col("q_key")).otherwise(F.col("p_key") != F.col("q_key"))
    same = (F.col("a") == F.col("to_a")) & (F.col("b") == F.col("to_b")) & (F.col("x") == F.col("to_x")) & (F.col("y") == F.col("to_y"))
    on = same & one
    return p.join(q, on if test is None else on & test).drop("a", "b", "x", "y", "to_a", "to_b", "to_x", "to_y")
