"""Bootstrap intervals of statistics over many rows, all replicates in one pass.

A row weighs Poisson(1) in each replicate. The draws come from the MD5 of seed, key and number, 16 bits each, eight to a
digest, so that they are the same on any cluster and in any engine. A row's weights are a vector; what a statistic needs is
sums of such vectors, so rows are added up element by element where they lie, a vector for each distinct value or moment,
and the number of rows of the plan does not grow with the replicates. An interval goes from one order statistic of the
replicates to another; replicates without a value are left out, and fewer than 20 of them give no interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import ONE_BLOCK, md5
from ..storage import durable

#: 65536 times the distribution function of Poisson(1), rounded down; a draw's weight is how many of these it reaches.
STEPS = [int(65536 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(8)]
#: Draws of a digest, distinct values that a task adds up before it sends them on, and replicates that make an interval.
DRAWS, HELD, LEAST = 8, 4096, 20


#: A draw's weight by its 16 bits, their two bytes the other way round, as they lie in a digest.
WEIGHT = np.searchsorted(STEPS, np.arange(1 << 16, dtype=np.uint16).byteswap(), side="right").astype(np.uint8)


def weights(keys: list[str], replicates: int, seed: int) -> np.ndarray:
    """A row for each key, a column for each replicate."""
    blocks = -(-replicates // DRAWS)
    heads = [f"{seed}|{key}|".encode() for key in keys]
    sizes = np.fromiter(map(len, heads), np.int64, len(heads))
    out = np.empty((len(keys), blocks, DRAWS), np.uint8)
    # heads of one length at a time: their messages differ in bytes alone, and one digest's steps go over all of them
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        same = np.frombuffer(b"".join(heads[r] for r in rows), np.uint8).reshape(len(rows), size)
        for b in range(blocks):
            tail = str(b).encode()
            if size + len(tail) <= ONE_BLOCK:
                digests = md5(same, tail)
            else:
                digests = np.frombuffer(b"".join(hashlib.md5(heads[r] + tail).digest() for r in rows), "<u4").reshape(-1, 4)
            out[rows, b] = WEIGHT[digests.view("<u2")]
    return out.reshape(len(keys), -1)[:, :replicates]


def ends(draws: np.ndarray, level: float) -> tuple[float | None, float | None]:
    """The order statistics at both tails of the replicates that have a value."""
    draws = np.sort(draws[np.isfinite(draws)])
    n, tail = len(draws), (1 - level) / 2
    if n < LEAST:
        return None, None
    return float(draws[int(tail * n)]), float(draws[min(n - 1, int((1 - tail) * n))])


def _vectors(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.tobytes() for x in c], pa.binary()) for c in columns]


def _by_value(replicates: int, seed: int):
    """Rows (key, score, positive) to (score, p, q): the weights of positives and of others at each score, and unweighted.

    The first element of a vector stands for the rows as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[float, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            both = list(sums.values())
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.float64()), *_vectors([[x[0] for x in both], [x[1] for x in both]])], names=["score", "p", "q"])

        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.array(batch.column("score"), float)
            side = np.where(np.array(batch.column("positive"), bool), 0, 1)
            w = np.column_stack((np.ones(len(score), np.uint8), weights(batch.column("key").to_pylist(), replicates, seed)))
            order = np.lexsort((side, score))
            score, side, w = score[order], side[order], w[order]
            starts = np.flatnonzero(np.concatenate(([True], (score[1:] != score[:-1]) | (side[1:] != side[:-1]))))
            for value, k, total in zip(score[starts].tolist(), side[starts].tolist(), np.add.reduceat(w, starts, dtype=np.int64), strict=True):
                sums.setdefault(value, np.zeros((2, replicates + 1), np.int64))[k] += total
            if len(sums) > HELD:
                yield out()
                sums.clear()
        if sums:
            yield out()

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of scores in order to one row: its first score, positives, others, and the pairs won within it."""
    first = value = None
    p = q = below = above = won = np.int64(0)
    for batch in batches:
        for x, a, b in zip(*(batch.column(k).to_pylist() for k in ("score", "p", "q")), strict=True):
            a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            if value is None:
                first = x
            elif x != value:
                won, above, below = won + p * (2 * below + q), above + p, below + q
                p = q = np.int64(0)
            value, p, q = x, p + a, q + b
    if value is not None:
        won, above, below = won + p * (2 * below + q), above + p, below + q
        yield pa.RecordBatch.from_arrays([pa.array([first]), *_vectors([[above], [below], [won]])], names=["first", "p", "q", "won"])


def _areas(level: float):
    """Ranges in order to one row: the area, its ends, and how many rows there are of either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = q = won = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("p", "q", "won")), strict=True):
                a, b, u = (np.frombuffer(x, np.int64) for x in row)
                p, q, won = (a, b, u) if p is None else (p + a, q + b, won + u + 2 * a * q)
        if p is None:
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            area = won / (2.0 * p * q)
        low, high = ends(area[1:], level)
        values = [float(area[0]) if np.isfinite(area[0]) else None, low, high]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.float64()) for x in values), pa.array([int(p[0])]), pa.array([int(q[0])])], names=["auc", "low", "high", "n_positive", "n_negative"])

    return run


def auc_interval(rows: DataFrame, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """auc, low, high, n_positive, n_negative of rows (key, score, positive); ties one half.

    Weights are added up by distinct score where the rows lie, sums are dealt by ranges of the score, each range is run
    through once for all replicates, and one row of each range is left to put together. Rows without score or side are left
    out; no rows give no row; counts of pairs are whole numbers, exact to 2**63.
    """
    fit = rows.select(F.col("key").cast("string").alias("key"), F.col("score").cast("double").alias("score"), "positive").where("key is not null and score is not null and not isnan(score) and positive is not null")
    # ranges are sampled first: written, so that the weights are not drawn a second time for that
    by = durable(fit.mapInArrow(_by_value(replicates, seed), "score double, p binary, q binary"))
    ranges = by.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(_scan, "first double, p binary, q binary, won binary")
    return ranges.repartition(1).sortWithinPartitions("first").mapInArrow(_areas(level), "auc double, low double, high double, n_positive long, n_negative long")


def _moments(replicates: int, seed: int):
    """Keys with all their scores to one row a task: sums over keys of 1, scores of each rater, squares, squared totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("scores").to_pylist(), float)
            w = np.column_stack((np.ones(len(x)), weights(batch.column("key").to_pylist(), replicates, seed)))
            parts = np.column_stack((np.ones(len(x)), x, (x * x).sum(axis=1), x.sum(axis=1) ** 2))
            total = parts.T @ w if total is None else total + parts.T @ w
        if total is not None:
            yield pa.RecordBatch.from_arrays(_vectors([[total]]), names=["m"])

    return run


def _correlations(k: int, level: float):
    """Sums of moments to the one row of the intraclass correlation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("m").to_pylist():
                m = np.frombuffer(raw).reshape(k + 3, -1)
                total = m if total is None else total + m
        if total is None:
            return
        n, by, squares, totals = total[0], total[1 : k + 1], total[k + 1], total[k + 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            grand = by.sum(axis=0) ** 2 / (n * k)
            rows, raters = totals / k - grand, (by**2).sum(axis=0) / n - grand
            msr, msc = rows / (n - 1), raters / (k - 1)
            mse = (squares - grand - rows - raters) / ((n - 1) * (k - 1))
            icc = (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)
        low, high = ends(icc[1:], level)
        yield pa.RecordBatch.from_arrays([pa.array([int(n[0])]), pa.array([k], pa.int64()), *(pa.array([x], pa.float64()) for x in (float(icc[0]) if np.isfinite(icc[0]) else None, low, high))], names=["n", "k", "icc", "low", "high"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("m").to_pylist():
            m = np.frombuffer(raw)
            total = m if total is None else total + m
    if total is not None:
        yield pa.RecordBatch.from_arrays(_vectors([[total]]), names=["m"])


def icc_interval(scores: DataFrame, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """n, k, icc, low, high: two-way random effects, single rater, absolute agreement, keys drawn anew.

    scores (key, rater, score); keys that not every rater has scored are left out. Moments of each task are summed, by
    several tasks first. Raters are few: their number is read, and a key's scores are one row. One rater, or no key that all
    have scored, gives no row.
    """
    given = scores.where("score is not null and key is not null and rater is not null")
    k = scores.agg(F.count_distinct("rater")).first()[0]
    by = given.groupBy(F.col("key").cast("string").alias("key"), "rater").agg(F.avg("score").alias("score"))
    keys = by.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rater", "score"))).alias("x")).where(F.size("x") == k)
    if k < 2:
        keys = keys.limit(0)
    moments = keys.select("key", F.transform("x", lambda s: s["score"].cast("double")).alias("scores")).mapInArrow(_moments(replicates, seed), "m binary")
    some = moments.repartition(16).mapInArrow(_summed, "m binary")
    return some.repartition(1).mapInArrow(_correlations(k, level), "n long, k long, icc double, low double, high double")
