"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Fitting takes a bounded sample, the vectors whose vec_id hashes lowest (``max_sample``): coarse centroids by k-means,
then one codebook for each group of dimensions over what the centroids leave. How many lists a query probes is measured
on the sample itself, each vector once: the fewest for which its own nearest neighbours are found with recall ``target``.

Every vector is put into the list of its nearest centroid, stored there with its codes and itself. Lists are cut into tiles of about ``tile``
vectors, and the queries that probe a list into groups of about ``tile``, so that a list or a vector that holds a third
of all rows is spread over many tasks. A task holds one tile and one group: tables of inner products between the parts
of each query and all code words (asymmetric distances) rank the tile, and the best ``rerank``, with all that come
within twice the tables' usual error of the k-th, are scored again with their original vectors in double precision, so
that crowds of vectors with equal codes are told apart. The tiles' answers are merged by query.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take
no part; ties go to the smaller vec_id; a query gets all candidates if there are fewer than ``k``; a repeated vec_id is
one more candidate, but not for its own id, and one more query; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, durable, hashed_sample, pick


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids, from evenly spaced rows of x; the same for the same rows in the same order."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)


@dataclass
class Index:
    """What every task knows: centroids (lists by dimensions), codebooks (groups by words by dimensions), probes.

    ``noise``: by how much approximate inner products are off on the sample, root mean square.
    """

    centroids: np.ndarray
    books: np.ndarray
    probes: int
    noise: float = 0.0

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, group: int = 4, words: int = 256, k: int = 20, target: float = 0.97) -> Index:
        x = np.unique(sample.astype(np.float64), axis=0)  # copies would stand for most neighbours and most centroids
        lists = max(1, min(lists, len(x)))
        c = k_means(x, lists)
        rest = x - c[nearest(x, c)]
        pad = -x.shape[1] % group
        parts = np.pad(rest, ((0, 0), (0, pad))).reshape(len(x), -1, group)
        books = np.stack([k_means(parts[:, g], min(words, len(x))) for g in range(parts.shape[1])])
        out = cls(c, books, lists)
        # how many lists hold the sample's own neighbours
        asked = x[:: max(1, len(x) // 400)]
        at = nearest(x, c)
        out.noise = float(np.sqrt(np.mean((asked @ (x - out.decode(out.encode(x, at), at)).T) ** 2)))
        score = asked @ x.T
        score[np.arange(len(asked)), np.arange(len(x))[:: max(1, len(x) // 400)]] = -np.inf
        best = np.argsort(-score, 1, kind="stable")[:, : min(k, len(x) - 1)]
        order = np.argsort(np.argsort(-(asked @ c.T), 1, kind="stable"), 1)
        rank = np.take_along_axis(order, at[best], 1)  # of each neighbour's list among the query's
        for probes in range(1, lists + 1):
            if not rank.size or (rank < probes).mean() >= target:
                out.probes = probes
                break
        return out

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        groups, _, width = self.books.shape
        rest = x - self.centroids[at]
        parts = np.pad(rest, ((0, 0), (0, groups * width - x.shape[1]))).reshape(len(x), groups, width)
        return np.stack([nearest(parts[:, g], self.books[g]) for g in range(groups)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = np.concatenate([self.books[g][codes[:, g]] for g in range(len(self.books))], 1)
        return self.centroids[at] + rest[:, : self.centroids.shape[1]]

    def approximate(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the coded vectors of list ``at``, from tables by group and code word."""
        groups, _, width = self.books.shape
        parts = np.pad(q, ((0, 0), (0, groups * width - q.shape[1]))).reshape(len(q), groups, width)
        out = np.repeat((q @ self.centroids[at])[:, None], len(codes), 1).astype(np.float32)
        for g in range(groups):
            out += (parts[:, g] @ self.books[g].T).astype(np.float32)[:, codes[:, g]]
        return out


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, row): finite, non-zero vectors of the most common length, in double precision; row numbers rows."""
    rows = pick(embeddings, vec_id="bigint", embedding="array<double>").where("vec_id is not null and size(embedding) > 0")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(good).select("vec_id", F.col("embedding").alias("v"))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (width[0].n if width else 0)).withColumn("row", F.monotonically_increasing_id())


def _place(shared: object, probe: bool):
    """(vec_id, v, row) with the own list and the codes there, or for a query a row for each list it probes, no codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        for rows in batches:
            if not len(rows):
                continue
            x = np.stack(rows["v"].to_numpy())
            if probe:
                at = np.argsort(-(x @ index.centroids.T), 1, kind="stable")[:, : index.probes]
                many = rows.loc[rows.index.repeat(at.shape[1])]
                yield many.assign(list=at.ravel().astype(np.int32), codes=b"")
            else:
                at = nearest(x, index.centroids)
                yield rows.assign(list=at.astype(np.int32), codes=[c.tobytes() for c in index.encode(x, at)])

    return run


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


def _close(score: np.ndarray, ids: np.ndarray, k: int, least: int, margin: float) -> np.ndarray:
    """Positions worth an exact look: the ``least`` best, and all within the margin of the k-th best."""
    if len(score) <= least:
        return np.arange(len(score))
    some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - margin) if k < len(score) else np.arange(len(score))
    return some if len(some) >= least else _top(score, ids, least)


FOUND = "query_id long, query_row long, vec_id long, row long, score double"


def _search(shared: object, k: int, rerank: int):
    def run(key: tuple, asked: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        index: Index = shared.value
        out: list[tuple[np.ndarray, ...]] = []
        if len(asked) and len(tile):
            ids, x = tile["vec_id"].to_numpy(np.int64), np.stack(tile["v"].to_numpy())
            codes = np.frombuffer(b"".join(tile["codes"]), np.uint8).reshape(len(x), -1)
            names, q = asked["vec_id"].to_numpy(np.int64), np.stack(asked["v"].to_numpy())
            own, rows = tile["row"].to_numpy(np.int64), asked["row"].to_numpy(np.int64)
            for a in range(0, len(q), 256):
                near = index.approximate(q[a : a + 256], int(key[0]), codes)
                for name, number, one, row in zip(names[a : a + 256], rows[a : a + 256], q[a : a + 256], near, strict=True):
                    row[own == number] = -np.inf
                    some = _close(row, ids, k, rerank, 2 * index.noise)
                    some = some[own[some] != number]
                    exact = np.einsum("ij,j->i", x[some], one)
                    best = _top(exact, ids[some], k)
                    out.append((np.full(len(best), name), np.full(len(best), number), ids[some][best], own[some][best], exact[best]))
        names = FOUND.replace(",", "").split()[::2]
        if not out:
            return pd.DataFrame({n: np.zeros(0, np.int64 if n != "score" else np.float64) for n in names})
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def search(embeddings: DataFrame, every: int = 20, k: int = 20, max_sample: int = 8192, rerank: int = 128, tile: int = 4096, target: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its k nearest other rows."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = durable(usable(embeddings))
    total = rows.count()
    sample = hashed_sample(rows, "vec_id", max_sample).toPandas()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    lists = int(min(4096, max(1, total**0.5 / 4), max(1, len(sample) / 32)))
    index = Index.fit(np.stack(sample["v"].to_numpy()), lists, k=k, target=target)
    shared = spark.sparkContext.broadcast(index)
    ddl = "vec_id long, v array<double>, row long, list int, codes binary"
    stored = durable(rows.mapInPandas(_place(shared, False), ddl))
    asked = durable(rows.where(F.col("vec_id") % every == 0).mapInPandas(_place(shared, True), ddl))
    # tiles of each list and groups of its queries: a row for each list
    sizes = stored.groupBy("list").agg(F.count("*").alias("n")).join(asked.groupBy("list").agg(F.count("*").alias("m")), "list")
    sizes = F.broadcast(durable(sizes.select("list", F.ceil(F.col("n") / tile).cast("int").alias("tiles"), F.ceil(F.col("m") / tile).cast("int").alias("groups"))))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "list").withColumn("group", part("groups")).withColumn("tile", each("tiles")).select("list", "tile", "group", "vec_id", "row", "v")
    right = stored.join(sizes, "list").withColumn("tile", part("tiles")).withColumn("group", each("groups")).select("list", "tile", "group", "vec_id", "row", "v", "codes")
    keys = ["list", "tile", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(shared, k, rerank), FOUND)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
