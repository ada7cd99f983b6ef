"""Clusters over batches are those of all pairs at once, and only what changes is written."""

from __future__ import annotations

import random
from pathlib import Path

from citeweft.operators.graph import clusters
from citeweft.operators.kept import Clusters


def modified(path):
    return {p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in Path(path).glob("part=*")}


def test_batches_are_as_all_at_once(spark, tmp_path):
    rng = random.Random(4)
    pairs = [(f"k{rng.randrange(120):03}", f"k{rng.randrange(120):03}") for _ in range(90)]
    df = spark.createDataFrame([*pairs, (None, "k001"), ("k002", None)], "a string, b string")
    kept = Clusters(spark, (tmp_path / "c").as_uri(), parts=8)
    assert kept.read().count() == 0
    for k in range(3):
        rows = pairs[k::3]
        n = kept.add(spark.createDataFrame(rows, "a string, b string").repartition(3))
        assert n > 0
    whole = sorted(map(tuple, clusters(df.where("a is not null and b is not null")).collect()))
    assert sorted(map(tuple, kept.read().collect())) == whole
    before = modified(tmp_path / "c")
    assert kept.add(df) == 0 and modified(tmp_path / "c") == before  # nothing merges, nothing is written
    assert kept.add(spark.createDataFrame([("new1", "new2")], "a string, b string")) == 2
    after = modified(tmp_path / "c")
    assert 1 <= sum(after[p] != before.get(p) for p in after) <= 2
    assert kept.read().where("rep = 'new1'").count() == 2 and kept.read().count() == len(whole) + 2


def test_a_chain_gives_way_to_a_smaller_key(spark, tmp_path):
    kept = Clusters(spark, (tmp_path / "d").as_uri(), parts=4)
    add = lambda *p: kept.add(spark.createDataFrame(list(p), "a string, b string"))
    assert add(("m", "n"), ("x", "y")) == 4
    assert add(("n", "x")) == 2  # x and y
    assert add(("a", "y"), ("a", "a")) == 5
    assert {r.rep for r in kept.read().collect()} == {"a"} and kept.read().count() == 5
