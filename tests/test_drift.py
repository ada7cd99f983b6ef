"""Refreshes through a fetcher, drift by summaries of ranges, conflicts of merges, agreement within families."""

from __future__ import annotations

import math

import numpy as np
import pytest
from citeweft.operators import resolve, stats, verify
from pyspark.sql import functions as F

CACHE = "cache_key string, provider string, method string, params string, response_hash string, body string"


def test_refresh_keeps_to_its_contract(spark):
    old = spark.createDataFrame([(k, "p", "m", "{}", "0", '{"id":"W1"}') for k in "abc"], CACHE)
    new = spark.createDataFrame([("a", 200, '{"id":"W1"}'), ("b", 404, None)], "cache_key string, http_status int, body string")
    seen = []

    def fetch(asked):
        seen.append(sorted(r.cache_key for r in asked.collect()))
        return new.join(asked.select("cache_key"), "cache_key", "left_semi")

    diffs, total = verify.refresh(old, fetch)
    assert {r.cache_key: r["class"] for r in diffs.collect()} == {"a": "metadata_changed", "b": "deindexed", "c": "deindexed"}
    assert total.collect()[0].asDict() == {"entries_checked": 3, "deindexed": 2, "ok": False}
    assert verify.refresh(old, fetch, 1)[1].collect()[0].asDict() == {"entries_checked": 1, "deindexed": 0, "ok": True}
    assert seen == [["a", "b", "c"], ["a"]]
    for answers, why in ((new.drop("body"), "body"), (new.union(new), "several"), (new.withColumn("cache_key", F.lit("zz")).limit(1), "not asked")):
        with pytest.raises(verify.FetchError, match=why):
            verify.refresh(old, lambda asked, answers=answers: answers)
    assert verify.refresh(old.limit(0), fetch)[1].collect()[0].entries_checked == 0


def test_only_ranges_that_differ_are_read(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("cache_key"), (F.col("id") % 17).alias("v"), F.lit(None).cast("string").alias("note"))
    base = tmp_path.as_uri()
    verify.snapshot(rows, f"{base}/a", ranges=32)
    verify.snapshot(rows.repartition(7), f"{base}/same", ranges=32)
    assert verify.drift_between(spark, f"{base}/a", f"{base}/same")[1] == []
    assert verify.drift_between(spark, f"{base}/a", f"{base}/same")[0].count() == 0
    other = rows.where("cache_key <> '7'").withColumn("v", F.when(F.col("cache_key") == "11", -1).otherwise(F.col("v"))).union(spark.createDataFrame([("new", 1, "x")], "cache_key string, v long, note string"))
    verify.snapshot(other, f"{base}/b", ranges=32)
    diff, parts = verify.drift_between(spark, f"{base}/a", f"{base}/b")
    assert sorted((r.cache_key, r.change) for r in diff.collect()) == [("11", "changed"), ("7", "removed"), ("new", "added")]
    assert 1 <= len(parts) <= 3
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan
    verify.snapshot(rows.limit(0), f"{base}/none", ranges=32)
    assert verify.drift_between(spark, f"{base}/none", f"{base}/none")[0].count() == 0
    assert verify.drift_between(spark, f"{base}/none", f"{base}/a")[0].where("change = 'added'").count() == 3000


def test_conflicts_of_a_merge(spark):
    prov = "array<struct<provider:string>>"
    rows = [("k1", None, 2000, "en", [("b",)]), ("k2", "T", 2001, "", [("a",)]), ("k3", "U", 2000, "de", [("b",)]), ("k4", "T", 2002, None, []), ("x", "T", 1, "en", [])]
    works = spark.createDataFrame([(k, t, y, g, p) for k, t, y, g, p in rows], f"key string, title string, year int, language string, provenance {prov}")
    labels = spark.createDataFrame([(k, "k1") for k in ("k1", "k2", "k3", "k4")] + [("x", "x")], "key string, rep string")
    got = {(r.field, r.kept, r.other) for r in resolve.merge_conflicts(works, labels).collect()}
    assert got == {("title", "T", "U"), ("year", "2000", "2002"), ("language", "en", "de")}
    got = {(r.field, r.kept, r.other) for r in resolve.merge_conflicts(works, labels, precedence=("a", "b")).collect()}
    assert got == {("title", "T", "U"), ("year", "2001", "2002"), ("language", "en", "de")}


def test_agreement_within_families(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(5, 2, 40)
    rows = [(k, r, float(base[k] + rng.normal() + s)) for k in range(40) for r, s in (("a1", 0), ("a2", 1), ("a3", -1), ("b1", 0), ("b2", 0.3), ("c1", 0))]
    rows = [r for r in rows if not (r[0] == 7 and r[1] == "b2")]
    scores = spark.createDataFrame(rows, "key int, rater string, score double")
    got = {r.family: r for r in stats.within_families(scores, F.substring("rater", 1, 1)).collect()}
    assert set(got) == {"a", "b"} and (got["a"].k, got["a"].n, got["b"].k, got["b"].n) == (3, 40, 2, 39)
    for family in "ab":
        own = scores.where(F.col("rater").startswith(family))
        assert math.isclose(got[family].icc, stats.icc21(stats.common_basis(own)).collect()[0].icc, rel_tol=1e-9)
