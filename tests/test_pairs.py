"""Pairs of blocks of any size, each once, dealt evenly."""

from __future__ import annotations

import random
from collections import Counter
from statistics import median

from citeweft.operators import pairs, resolve
from pyspark.sql import functions as F


def plain(rows, test=lambda a, b: True):
    keys: dict = {}
    for block, key, v in rows:
        if block is not None and key is not None:
            keys.setdefault(block, []).append((key, v))
    return sorted((b, x, y) for b, own in keys.items() for x, v in own for y, w in own if x < y and test(v, w))


def test_pairs_of_all_blocks(spark, monkeypatch):
    """Blocks far beyond a tile, small ones, single records, nulls; the smaller key first, columns with their key."""
    monkeypatch.setattr(pairs, "SIDES", (8, 8))
    rng = random.Random(2)
    rows = [("hot" if k % 3 == 0 else f"b{rng.randrange(40)}", f"k{k:04}", rng.randrange(50)) for k in range(500)]
    rows += [(None, "k9", 1), ("hot", None, 1), ("alone", "z", 3)]
    df = spark.createDataFrame(rows, "block string, key string, v int").repartition(5)
    got = pairs.block_pairs(df, "key", ("key", "v")).collect()
    assert sorted((r.block, r.a_key, r.b_key) for r in got) == plain(rows)
    value = {k: v for _, k, v in rows}
    assert all((r.a_v, r.b_v) == (value[r.a_key], value[r.b_key]) for r in got)
    near = pairs.block_pairs(df, "key", ("key", "v"), F.abs(F.col("a_v") - F.col("b_v")) <= 2).collect()
    assert sorted((r.block, r.a_key, r.b_key) for r in near) == plain(rows, lambda a, b: abs(a - b) <= 2)
    assert pairs.block_pairs(df.limit(0), "key", ("key", "v")).count() == 0


def test_a_repeated_key_pairs_with_others_alone(spark):
    df = spark.createDataFrame([("b", "x"), ("b", "x"), ("b", "y")], "block string, key string")
    assert [(r.a_key, r.b_key) for r in pairs.block_pairs(df, "key", ("key",)).collect()] == [("x", "y")] * 2


def test_one_block_of_20000_records_is_dealt_evenly(spark):
    """Pairs that each task of the join meets: none takes over twice the median, at several numbers of partitions."""
    rows = spark.range(20_000).select(F.lit("hot").alias("block"), F.col("id").cast("string").alias("key"))
    rows = rows.union(spark.range(5000).select(F.concat(F.lit("b"), F.floor(F.col("id") / 5)).alias("block"), F.concat(F.lit("s"), "id").alias("key")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            each = pairs.chunked(rows, "key").groupBy("block", "chunk", "chunks").count().collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        n = {(r.block, r.chunk): r["count"] for r in each}
        tiles = [(r.block, r.chunk, other) for r in each for other in range(r.chunk, r.chunks)]
        at = spark.createDataFrame(tiles, "block string, chunk int, other int").select("*", F.pmod(F.hash("block", "chunk", "other"), F.lit(parts)).alias("task")).collect()
        load: Counter = Counter()
        for r in at:
            a, b = n.get((r.block, r.chunk), 0), n.get((r.block, r.other), 0)
            load[r.task] += a * (a - 1) // 2 if r.chunk == r.other else a * b
        assert sum(load.values()) == 20_000 * 19_999 // 2 + 1000 * 10
        assert len(load) == parts and max(load.values()) <= 2 * median(load.values())


def test_hot_blocks_of_titles_match_as_small_ones(spark, monkeypatch):
    """All tiers, with a block of 400 records in tiles of 16."""
    rng = random.Random(3)
    title = "a shared opening of titles "
    rows = [(f"k{k:03}", title + rng.choice(["one", "two", "twa", "tree"]), 2000, rng.choice(["cook", "amcook", "", "li"]), None) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, title_norm string, year int, surname string, doi string")
    want = sorted(map(tuple, resolve.matches(df).collect()))
    monkeypatch.setattr(pairs, "SIDES", (16, 16))
    assert sorted(map(tuple, resolve.matches(df).collect())) == want and len(want) > 10_000
