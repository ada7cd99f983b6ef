"""Importance resampling of documents towards a target distribution, on hashed n-grams.

Features are all runs of one to three consecutive words (letters and digits of ASCII, and everything beyond it; A-Z in
lower case), joined by a blank; a feature's bucket is the CRC-32 of its UTF-8 modulo ``BUCKETS``. A bucket's gain is the
floor of 1000 times the log ratio of its smoothed shares in the target and in the documents; a document weighs the sum of
its features' gains. With Gumbel noise drawn from a hash of its id on top, the highest scores are a sample without
replacement in proportion to the weights.

Byte automaton: a batch's texts are one Arrow buffer. A table of 256 classes tells which bytes are in words, differences
of neighbours give where words begin and end (a text's end is a word's end), and the table-driven CRC advances over all
words at once, a byte a step: words are sorted by length, so those that are still running stand in front. Starts go on
from their state after one word over a blank and the next word, twice. Words beyond ``LONG`` bytes go through zlib.

Two passes over the texts: bucket counts, summed by the tasks (at most ``BUCKETS`` rows of each, to the driver ``BUCKETS``
rows), then weights with the gains, a fixed table, broadcast. Scores are dealt by ranges and numbered in each.

Edge cases: null and empty texts have no features and weigh 0; a null doc_id hashes as an empty one, and comes last of its
score; rows with one doc_id are documents of their own; an empty table gives no rows, an empty target only smooths; further
columns are dropped. Arrow batches are bounded by bytes, a setting of the session that stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, durable, pick

BUCKETS = 10_000
#: Consecutive words in a feature, at most.
RUNS = 3
#: Words that advance together, and bytes of a word that go step by step.
CHUNK, LONG = 1 << 16, 64

_byte = np.arange(256)
#: Classes of bytes: in a word or not, and what a byte counts as.
IN_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


def _steps() -> np.ndarray:
    """The CRC-32 after each byte: eight shifts of the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


STEP = _steps()


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: its bytes in lower case, where each word begins, its bytes, and the words of each text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = ends[:-1] < ends[1:]
    first[ends[:-1][some]] = inside[ends[:-1][some]]
    last[ends[1:][some] - 1] = inside[ends[1:][some] - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    return LOWER[raw], starts, sizes, np.diff(np.searchsorted(starts, ends))


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after data[start : start + size] each. Sizes fall, but for those beyond LONG, which come first."""
    state = state.copy()
    beyond = int(np.searchsorted(-np.minimum(sizes, LONG + 1), -LONG))
    for k in range(beyond):
        a = int(starts[k])
        state[k] = zlib.crc32(data[a : a + int(sizes[k])], int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    starts, sizes, rest = starts[beyond:], sizes[beyond:], state[beyond:]
    running = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0))
    for j, m in enumerate(running.tolist()):
        now = rest[:m]
        rest[:m] = STEP[(now ^ data[starts[:m] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    return state


def buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of all features, in blocks."""
    data, starts, sizes, counts = words_of(column)
    text = np.repeat(np.arange(len(counts)), counts)
    for a in range(0, len(starts), CHUNK):
        b = min(len(starts), a + CHUNK)
        to = min(len(starts), b + RUNS - 1)
        at, size, of = starts[a:to], sizes[a:to], text[a:to]
        order = np.argsort((0xFFFF - np.minimum(size, 0xFFFF)).astype(np.uint16), kind="stable")
        state = np.full(b - a, 0xFFFFFFFF, np.uint32)
        for k in range(RUNS):
            last = order[(order >= k) & (order < b - a + k)]
            last = last[of[last] == of[last - k]]
            now = state[last - k]
            if k:
                now = STEP[(now ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
            now = advance(now, data, at[last], size[last])
            state[last - k] = now
            yield of[last], ((now ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (bucket, n) of all of a task's features."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, bucket in buckets(batch.column("text")):
            n += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])


def _weigh(gains: object):
    """Texts to their words, features and weights; ``place`` numbers a task's rows, so that no two of it are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, place = gains.value, 0
        for batch in batches:
            column = batch.column("text")
            counts = words_of(column)[3]
            weight = np.zeros(len(column), np.int64)
            for text, bucket in buckets(column):
                weight += np.bincount(text, gain[bucket], minlength=len(column)).astype(np.int64)  # exact below 2**53
            features = sum(np.maximum(counts - k, 0) for k in range(RUNS))
            places = np.arange(place, place + len(column))
            place += len(column)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (counts, features, weight, places))], names=["doc_id", "n_words", "n_features", "weight", "place"])

    return run


def gains_of(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from all features of both tables (text)."""
    both = documents.mapInArrow(_count, "bucket int, n long").withColumn("s", F.lit(True)).union(target.mapInArrow(_count, "bucket int, n long").withColumn("s", F.lit(False)))
    sums = both.groupBy("bucket").agg(F.sum(F.when(F.col("s"), F.col("n"))).alias("s"), F.sum(F.when(~F.col("s"), F.col("n"))).alias("t"))
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # a row for each bucket
        s[r.bucket], t[r.bucket] = r.s or 0, r.t or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Rows with the rank of the highest scores: ``percent`` of those that may be drawn, ties to the smaller doc_id.

    Rows are dealt by ranges of their order, sizes of the ranges (a row for each partition) say where each begins, and
    only ranges that hold drawn rows are numbered.
    """
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place").asc()]
    dealt = durable(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.where("may").groupBy("part").agg(F.count("*").alias("size"))
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.floor(F.sum("size").over(Window.partitionBy()) * percent / 100).alias("most"))
    placed = dealt.join(F.broadcast(sizes), "part", "left")
    inside = F.col("may") & (F.col("before") < F.col("most"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    some = placed.where(inside).withColumn("rank", number).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")).cast("bigint"))
    rest = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return some.union(rest).drop("part", "before", "most")


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``documents``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = pick(documents, doc_id="bigint", text="string")
    gains = spark.sparkContext.broadcast(gains_of(rows.select("text"), pick(target, text="string")))
    weighed = rows.mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long, place long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("may", F.col("n_words") >= least_words)
    return ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")
