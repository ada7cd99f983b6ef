"""Intervals by replicates against statistics that are worked out replicate by replicate."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from citeweft.operators import intervals, stats
from pyspark.sql import functions as F


def drawn(key, r, seed=0):
    digest = hashlib.md5(f"{seed}|{key}|{r // 8}".encode()).digest()
    u = int.from_bytes(digest[2 * (r % 8) : 2 * (r % 8) + 2], "big")
    return sum(u >= s for s in intervals.STEPS)


def order_statistics(values, level=0.95):
    values, tail = sorted(values), (1 - level) / 2
    return values[int(tail * len(values))], values[min(len(values) - 1, int((1 - tail) * len(values)))]


def plain_auc(rows, weight):
    won = p = q = 0.0
    for k, s, a in rows:
        p, q = p + weight(k) * a, q + weight(k) * (not a)
    for k, s, a in rows:
        for j, t, b in rows:
            if a and not b:
                won += weight(k) * weight(j) * (1 if s > t else 0.5 if s == t else 0)
    return won / (p * q) if p * q else None


def test_weights_are_poisson():
    w = intervals.weights([str(k) for k in range(3000)], 50, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert [w[7, r] for r in range(50)] == [drawn("7", r, 1) for r in range(50)]


def test_digests_are_made_together(monkeypatch):
    """Keys of any length and letters draw as their MD5 says; only what passes one block is digested one by one."""
    keys = [*map(str, range(300)), "", "é|ß", "a\0", *("b" * n for n in (50, 51, 52, 53, 80))]
    want = [[drawn(k, r) for r in range(100)] for k in keys]
    calls, md5 = [], hashlib.md5
    monkeypatch.setattr(intervals.hashlib, "md5", lambda x: calls.append(x) or md5(x))
    assert intervals.weights(keys, 100, 0).tolist() == want
    assert 0 < len(calls) < 100 and all(len(x) > 55 for x in calls)


@pytest.mark.parametrize("partitions", [1, 7])
def test_auc_interval(spark, monkeypatch, partitions):
    """Ties within and over ranges of scores, sums that a task sends on early."""
    monkeypatch.setattr(intervals, "HELD", 3)
    rng = random.Random(5)
    rows = [(k, float(rng.choice([1, 2, 2, 2, 3, 4.5, -1])), rng.random() < 0.4) for k in range(80)]
    df = spark.createDataFrame([*rows, (None, 1.0, True), (900, None, False), (901, math.nan, True), (902, 1.0, None)], "key long, score double, positive boolean")
    got = intervals.auc_interval(df.repartition(partitions), replicates=40).collect()[0]
    areas = [plain_auc(rows, lambda k, r=r: drawn(k, r)) for r in range(40)]
    low, high = order_statistics([a for a in areas if a is not None])
    assert math.isclose(got.auc, plain_auc(rows, lambda k: 1)) and (got.n_positive, got.n_negative) == (sum(a for *_, a in rows), sum(not a for *_, a in rows))
    assert math.isclose(got.low, low) and math.isclose(got.high, high) and got.low < got.auc < got.high
    plain = stats.auc(df.where("key is not null and score is not null and not isnan(score) and positive is not null")).collect()[0]
    assert math.isclose(plain.auc, got.auc)


def test_no_interval_without_both_kinds(spark):
    one = spark.createDataFrame([(1, 2.0, True), (2, 3.0, True)], "key long, score double, positive boolean")
    r = intervals.auc_interval(one).collect()[0]
    assert (r.auc, r.low, r.high, r.n_positive, r.n_negative) == (None, None, None, 2, 0)
    assert intervals.auc_interval(one.limit(0)).count() == 0


def test_replicates_make_no_rows(spark):
    """The rows that are shuffled: one for each distinct score and task, at 10 replicates as at 400."""
    df = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 9).cast("double").alias("score"), (F.col("id") % 2 == 0).alias("positive")).repartition(3)
    rows = [df.select(F.col("key").cast("string").alias("key"), "score", "positive").mapInArrow(intervals._by_value(n, 0), "score double, p binary, q binary").count() for n in (10, 400)]
    assert rows[0] == rows[1] <= 27


def test_icc_interval(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(5, 2, 60)
    rows = [(int(k), r, float(round(base[k] + rng.normal(0, 1) + shift))) for k in range(60) for r, shift in (("a", 0), ("b", 0.5), ("c", -0.5))]
    rows += [(99, "a", 3.0), (98, "b", None)]
    df = spark.createDataFrame(rows, "key long, rater string, score double")
    got = intervals.icc_interval(df.repartition(5), replicates=60).collect()[0]
    whole = stats.icc21(stats.common_basis(df)).collect()[0]
    assert (got.n, got.k) == (60, 3) and math.isclose(got.icc, whole.icc, rel_tol=1e-9)
    x = np.array([[s for _, _, s in rows[3 * k : 3 * k + 3]] for k in range(60)])

    def plain(r):
        t = np.repeat(x, [drawn(k, r) for k in range(60)], axis=0)
        n, k, m = len(t), 3, t.mean()
        msr, msc = k * ((t.mean(axis=1) - m) ** 2).sum() / (n - 1), n * ((t.mean(axis=0) - m) ** 2).sum() / (k - 1)
        mse = ((t - t.mean(axis=1, keepdims=True) - t.mean(axis=0) + m) ** 2).sum() / ((n - 1) * (k - 1))
        return (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)

    low, high = order_statistics([plain(r) for r in range(60)])
    assert math.isclose(got.low, low, rel_tol=1e-9) and math.isclose(got.high, high, rel_tol=1e-9)
    assert intervals.icc_interval(df.where("rater = 'a'")).count() == 0
