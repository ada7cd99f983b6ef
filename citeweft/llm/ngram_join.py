"""N-gram Jaccard self-join with parity sketches.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. Two documents link when their sets' Jaccard
similarity is 0.8 or more. For sets of a and b elements the symmetric difference is then (a + b) / 9 at most, and no
size is over 1.25 times the other.

Sketch: every shingle flips one bit, chosen by its hash. Each element of the symmetric difference changes one bit at
most, so the Hamming distance of two sketches is a lower bound of that difference D. The sketch is made of p blocks,
p > D, the same for all sets of a size band (a power of two up to the next; sets that could have partners in the band
above are sketched there as well); one is kept as the XOR of the hashes of its set bits, which parity keeps right. By the
pigeonhole principle p - D blocks or more agree. A set therefore emits only its D + 1 best blocks: in the global order of
blocks the best one on which two similar sets agree is among the D + 1 best of both, whatever the order. Rare blocks come
first: a block is as rare as its rarest shingle, by a table of counts over all texts (``counters`` numbers, summed over
the tasks), then go those with more bits, then by key. So a passage that a large part of the texts shares, or an empty
block, makes a bucket only among texts that hold little else, and no link is lost: the table only orders.

Join: sets are never paired all with all. Equal sets are one class from the start, named by a 64-bit hash (each task
sketches a class once). Block keys are dealt packed: a task sorts some hundred thousand of them and sends each part of
their range as one value, 48 bits of each key as the difference from the one before, with the number of its set, so that
a key takes the same few bytes at any size of the input. (Where 48 bits agree by chance, a bucket holds more; no link is
lost.) Of each bucket of equal block keys, every member meets one pivot, the set with the most common shingles: of near
copies, the least changed one. Each class is verified with the pivot that it shares most buckets with, and linked classes
become components. Buckets whose members are then all in one component are done; a bitmap of the other members tells
which. In the others, members of different components meet, pass the size test and the Hamming test of 512-bit folded
sketches, and are verified. Verification intersects the whole sets. Tables go as soon as nothing reads them.

Edge cases: empty or null texts have an empty set and are linked with nothing; fewer than five words are one shingle;
rows with the same doc_id count as one document; a null doc_id is a document of its own, whose component is the
smallest id that it reaches, or null; any 64-bit doc_id will do; repeated rows stay; an empty table gives no rows.
Equality of sets and shingles is that of their 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, durable, pick, shuffles_let_go
from .components import components
from .hashing import U, WordHashes, mix64, shingles, split, texts

#: Bits of the bitmaps that tell which documents and buckets need not be read again; fixed, whatever the input.
BITMAP = 1 << 26
#: Keys that a task packs at a time, and keys that are put in buckets at a time.
PACKED, GROUPED = 1 << 19, 1 << 22
#: Members that go in one batch of buckets.
MEMBERS = 1 << 17
#: Counters that go in one row.
PART = 1 << 12


def most_different(n: int) -> int:
    """The largest symmetric difference with any partner."""
    return (n + 5 * n // 4) // 9


def blocks_of(level: int) -> int:
    """Blocks of the sketches of sets with up to 2**(level + 1) - 1 elements; more than any difference between them."""
    return 2 << level


def levels(n: int) -> list[int]:
    """The bands in which a set of n elements meets partners: its own, and the next if a larger partner may be there."""
    j = n.bit_length() - 1
    return [j, j + 1] if 5 * n // 4 >= 2 << j else [j]


def centre(s: np.ndarray, counts: np.ndarray) -> int:
    """How common a set's shingles are, in 1024ths of a binary digit: of near copies, the one with the fewest changes."""
    return int(counts[(s & U(len(counts) - 1)).astype(np.int64)].mean() * 1024)


def block_keys(s: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The join keys of a set, sorted shingle hashes: its best blocks in each of its bands.

    counts: binary digits of how often shingles occur, by the last bits of their hashes.
    """
    n = len(s)
    keep, hashed = most_different(n) + 1, mix64(s + U(0x9E3779B97F4A7C15))
    often = np.zeros(n, U) if counts is None else counts[(s & U(len(counts) - 1)).astype(np.int64)].astype(U)
    out = []
    for level in levels(n):
        p = blocks_of(level)
        block = ((s >> U(32)) * U(p)) >> U(32)  # does not fall, as s is sorted
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        parity = np.bitwise_xor.reduceat(hashed, starts)
        count = np.diff(np.append(starts, n)).astype(U)
        rare = np.minimum.reduceat(often, starts)
        place = block[starts]
        if len(place) < keep:
            empty = np.setdiff1d(np.arange(p, dtype=U), place, assume_unique=True)
            none = np.zeros(len(empty), U)
            place, parity, count = np.concatenate((place, empty)), np.concatenate((parity, none)), np.concatenate((count, none))
            rare = np.concatenate((rare, none + U(63)))
        key = mix64(mix64(parity) ^ mix64(place + U((level + 1) << 40)))
        if len(key) > keep:
            order = (rare << U(58)) | (U(15) - np.minimum(count, U(15)) << U(54)) | (key >> U(10))
            key = key[np.argpartition(order, keep - 1)[:keep]]
        out.append(key)
    return np.concatenate(out) if len(out) > 1 else out[0]


def folded(s: np.ndarray) -> list[int]:
    """The parity sketch folded to 512 bits, as eight signed numbers."""
    bits = (np.bincount((s & U(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("no", pa.int64()), ("sketch", pa.list_(pa.int64())), ("part", pa.int64()), ("blob", pa.binary())])
FIRST_DDL = "doc_id long, n long, c long, no long, sketch array<long>, part long, blob binary"
BUCKETS_DDL = "key long, c array<long>, n long, pivot long"
SETS_DDL = "doc_id long, c long, items array<long>"


def _named(s: np.ndarray) -> int:
    """A set's class: a hash of all its elements."""
    return int(mix64(np.array([len(s)], U) + mix64(s * U(0x9E3779B97F4A7C15) + U(1)).sum(dtype=U)).view(np.int64)[0])


class _New:
    """Which sets a task has not met lately."""

    def __init__(self, most: int = 50_000):
        self.seen, self.most = set(), most

    def __call__(self, name: int) -> bool:
        if len(self.seen) > self.most:
            self.seen.clear()
        out = name not in self.seen
        self.seen.add(name)
        return out


def _occurrences(counters: int):
    """Texts to (part, w): in how many sets shingles occur, by the last bits of their hashes; copies count once a task.

    Counters are deflated: most are 0, 1 or 2, and every task sends all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, new, counts = WordHashes(), _New(), np.zeros(counters, np.uint32)
        for batch in batches:
            for text in texts(batch.column("text")):
                s = shingles(cache.of(split(text)))
                if len(s) and new(_named(s)):
                    np.add.at(counts, (s & U(counters - 1)).astype(np.int64), np.uint32(1))
        for part, a in enumerate(range(0, counters, PART)):
            if (some := counts[a : a + PART]).any():
                small = np.uint8 if some.max() < 1 << 8 else np.uint16 if some.max() < 1 << 16 else np.uint32
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(some.astype(small).tobytes(), 1)], pa.binary())], names=["part", "w"])

    return run


def _digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counters as numbers of binary digits."""
    sums: dict[int, np.ndarray] = {}
    kinds = {PART: np.uint8, 2 * PART: np.uint16, 4 * PART: np.uint32}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("w"), strict=True):
            buffer = zlib.decompress(raw.as_buffer())
            sums.setdefault(part, np.zeros(PART, np.int64))
            sums[part] += np.frombuffer(buffer, kinds[len(buffer)])
    for part, w in sums.items():
        digits = np.ceil(np.log2(w + 1.0)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([digits.tobytes()], pa.binary())], names=["part", "w"])


def occurrences(rows: DataFrame, most: int = 1 << 22) -> np.ndarray:
    """Binary digits of how often shingles occur in all texts; ``most`` counters, fewer for few texts: they only order."""
    counters = 1 << min(most.bit_length() - 1, max(12, (16 * rows.count()).bit_length()))
    got = durable(rows.select("text").mapInArrow(_occurrences(counters), "part int, w binary").repartition("part").mapInArrow(_digits, "part int, w binary"))
    out = np.zeros(counters, np.uint8)
    for r in got.toLocalIterator():  # a byte for each counter
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(bytes(r.w), np.uint8)
    return out


def packed(task: int, keys: np.ndarray, at: np.ndarray, centres: np.ndarray) -> bytes:
    """Sorted 48-bit keys, the sets of a task that have them, and how common those are, as one value.

    Keys go as differences. Every byte of a number goes with its like, deflated where that is shorter, left out where
    all are 0.
    """
    n = len(keys)
    columns = (np.diff(keys, prepend=U(0)), 6), (at.astype("<u4"), 4), (centres.astype("<u2"), 2)
    planes = [x.view(np.uint8).reshape(n, -1)[:, k].tobytes() for x, width in columns for k in range(width)]
    short = [b"" if not any(p) else min(p, pa.compress(p, "zstd", asbytes=True), key=len) for p in planes]
    return np.array([task, n, *map(len, short)], "<u4").tobytes() + b"".join(short)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, numbers of their sets, and how common those are."""
    task, n, *ends = np.frombuffer(blob, "<u4", 14).tolist()
    planes, start = np.zeros((12, n), np.uint8), 56
    for plane, size in zip(planes, ends, strict=True):
        if size:
            part = blob[start : start + size]
            plane[:] = np.frombuffer(part if size == n else pa.decompress(part, n, "zstd", asbytes=True), np.uint8)
        start += size

    def number(first: int, last: int, kind: type) -> np.ndarray:
        out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        out[:, : last - first] = planes[first:last].T
        return out.view(kind).reshape(n)

    return np.cumsum(number(0, 6, U)), number(6, 10, np.uint32).astype(np.int64) + (task << 32), number(10, 12, np.uint16)


def _dealt(spark: SparkSession, parts: int) -> np.ndarray:
    """A number for each part of the keys, such that Spark's hash deals every part to a partition of its own."""
    out = np.arange(20 * parts, 21 * parts)
    for r in spark.range(20 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("at")).toLocalIterator():
        out[r.at] = min(out[r.at], r.id)
    return out


def _sketches(counts: object, dealt: np.ndarray):
    """Texts to rows of documents, and, in rows with a part, their packed keys. A set's ``no`` is its task and place."""
    parts = len(dealt)

    def deal(task: int, keys: list[np.ndarray], first: int, centres: list[int]) -> Iterator[pa.RecordBatch]:
        sizes = [len(k) for k in keys]
        flat = np.concatenate(keys) >> U(16)
        order = np.argsort(flat)
        flat, at = flat[order], np.repeat(np.arange(first, first + len(keys)), sizes)[order]
        centre_ = np.repeat(np.minimum(centres, 65535), sizes)[order]
        part = ((flat >> U(16)) * U(parts)) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        blobs = [packed(task, flat[a:b], at[a:b], centre_[a:b]) for a, b in zip(starts, [*starts[1:], len(flat)], strict=True)]
        none = [pa.nulls(len(blobs), t) for t in FIRST.types[:5]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(dealt[part[starts].astype(np.int64)], pa.int64()), pa.array(blobs, pa.binary())], schema=FIRST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, first, task = WordHashes(), _New(), TaskContext.get().partitionId()
        keys: list[np.ndarray] = []
        centres: list[int] = []
        done = held = 0  # sets whose keys have gone out, keys that have not
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: list[list] = [[] for _ in range(5)]
            for doc, text in zip(ids, texts(batch.column("text")), strict=True):
                s = shingles(cache.of(split(text)))
                name = _named(s)
                new = len(s) and first(name)
                no = (task << 32) + done + len(keys) if new else None
                for column, value in zip(rows, (doc, len(s), name, no, folded(s) if new else None), strict=True):
                    column.append(value)
                if new:
                    keys.append(block_keys(s, counts.value))
                    centres.append(centre(s, counts.value))
                    held += len(keys[-1])
                if held >= PACKED:
                    yield from deal(task, keys, done, centres)
                    done, held, keys, centres = done + len(keys), 0, [], []
            columns = [pa.array(c, t) for c, t in zip(rows, FIRST.types, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(ids), t) for t in FIRST.types[5:])], schema=FIRST)
        if held:
            yield from deal(task, keys, done, centres)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed keys of whole parts to the keys that several sets have: numbers of the sets, how many, the pivot.

    The pivot is the smallest number of those with the most common shingles. Of the copies of a set, which have the same
    keys, no other than the smallest number can be one.
    """
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            blobs.setdefault(part, []).append(blob)
    for part in sorted(blobs):
        own = blobs.pop(part)
        spans = 1 + sum(int(np.frombuffer(b, "<u4", 2)[1]) for b in own) // GROUPED
        for span in range(spans):  # by the keys' last bits, so that memory is bounded
            some = [unpacked(b) for b in own]
            if spans > 1:
                some = [tuple(x[at] for x in b) for b in some for at in [((b[0] & U(0xFFFF)) * U(spans)) >> U(16) == U(span)]]
            key, no, often = (np.concatenate(x) for x in zip(*some, strict=True))
            del some
            order = np.argsort(key, kind="stable")  # merges what is sorted already
            key = key[order]
            same = key[1:] == key[:-1]
            many = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
            key, no, often = key[many], no[order[many]], often[order[many]]
            order = np.lexsort((-no, often, key))  # the pivot comes last
            no, starts = no[order], np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else many
            ends = np.append(starts[1:], len(key))[: len(starts)]
            a = 0
            while a < len(starts):
                b = max(a + 1, int(np.searchsorted(ends, starts[a] + MEMBERS)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts[a:b], ends[b - 1]) - starts[a], pa.int32()), pa.array(no[starts[a] : ends[b - 1]]))
                columns = key[starts[a:b]].view(np.int64), lists, ends[a:b] - starts[a:b], no[ends[a:b] - 1]
                yield pa.RecordBatch.from_arrays([x if x is lists else pa.array(x, pa.int64()) for x in columns], names=["key", "c", "n", "pivot"])
                a = b


def _place(pivot: np.ndarray, no: np.ndarray) -> np.ndarray:
    """The bit of a pivot and another set in a bitmap."""
    return (mix64(mix64(pivot.view(U)) + no.view(U)) & U(BITMAP - 1)).astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pivot, no = (np.array(batch.column(k), np.int64) for k in ("pivot", "no"))
        yield pa.RecordBatch.from_arrays([pa.array(_place(pivot, no))], names=["slot"])


def _open(bitmap: object):
    """The members of buckets with a member that the bitmap, a broadcast, does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, pivot = (np.array(batch.column(k), np.int64) for k in ("key", "n", "pivot"))
            no = np.array(batch.column("c").flatten(), np.int64)
            place = _place(np.repeat(pivot, n), no)
            hit = (bits[place >> 6] >> (place & 63)) & 1
            some = np.repeat(np.maximum.reduceat(hit, np.cumsum(n) - n), n) > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)[some]), pa.array(no[some])], names=["key", "no"])

    return run


def _sets(bitmap: object):
    """For the second pass: the whole sets of the documents that the bitmap, a broadcast, does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = WordHashes(), bitmap.value
        for batch in batches:
            ids = batch.column("slot").to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero((bits[ids >> 6] >> (ids & 63)) & 1)
            if not len(wanted):
                continue
            part = batch.take(pa.array(wanted))
            sets: list[np.ndarray] = []
            first = size = 0
            for k, text in enumerate(texts(part.column("text"))):
                sets.append(shingles(cache.of(split(text))))
                size += len(sets[-1])
                if size >= 1 << 17 or k == part.num_rows - 1:  # sets go out in small batches, too
                    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                    items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                    ids_ = part.column("doc_id").slice(first, len(sets))
                    yield pa.RecordBatch.from_arrays([ids_, pa.array([_named(s) for s in sets], pa.int64()), items], names=["doc_id", "c", "items"])
                    first, sets, size = k + 1, [], 0

    return run


def _slot(doc_id: Column) -> Column:
    """A document's bit in the bitmap; all rows without a doc_id share the first."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(BITMAP)), F.lit(0))


def _fits(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """The bits that ``slot`` names, 64 to a number."""
    words = slots.distinct().groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    bits = np.zeros(BITMAP >> 6, np.int64)
    got = words.toPandas()  # at most BITMAP / 64 rows
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return bits


def verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose whole sets are similar. rows: (doc_id, text); classes: c, doc."""
    spark = rows.sparkSession
    names = durable(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct())
    shared = spark.sparkContext.broadcast(_bitmap(names.join(classes, "c").select(_slot(F.col("doc")).alias("slot"))))
    sets = durable(rows.withColumn("slot", _slot(F.col("doc_id"))).mapInArrow(_sets(shared), SETS_DDL).select("c", "items"))
    # several rows of a document, or several without an id, may be read; the shuffle that finds them serves both joins
    one = sets.join(names, "c", "left_semi").dropDuplicates(["c"])
    left = pairs.join(one.select(F.col("c").alias("b"), F.col("items").alias("b_items")), "b")
    met = left.join(one.select(F.col("c").alias("a"), F.col("items").alias("a_items")), "a")
    both = F.size(F.array_intersect("a_items", "b_items"))
    met = met.select("a", "b", both.alias("both"), (F.size("a_items") + F.size("b_items")).alias("sizes"))
    links = durable(met.where("100L * both >= 80L * (sizes - both)").select("a", "b"))
    drop(sets)
    return links


def near_duplicates(documents: DataFrame, counters: int = 1 << 22) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``documents``.

    Shuffles go as the jobs that wrote them end. Arrow batches are bounded by bytes, a setting of the session that stays.
    """
    with shuffles_let_go(documents.sparkSession):
        return _near_duplicates(documents, counters)


def _near_duplicates(documents: DataFrame, counters: int) -> DataFrame:
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = pick(documents, doc_id="bigint", text="string")
    counts = spark.sparkContext.broadcast(occurrences(rows, counters))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = durable(rows.mapInArrow(_sketches(counts, _dealt(spark, parts)), FIRST_DDL))
    docs = durable(first.where("part is null").select("doc_id", "n", "c", "no", "sketch"))
    # buckets of equal keys, with a pivot; keys are dealt once, as they take more room than all else
    buckets = durable(first.where("part is not null").select("part", "blob").repartition(parts, "part").mapInArrow(_buckets, BUCKETS_DDL))
    drop(first)
    full = docs.where("n > 0")
    classes = durable(full.groupBy("c").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min("no").alias("no")))
    # documents that stand in several rows tie their classes
    ids = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    same = durable(full.select("doc_id", "c").join(ids, "doc_id").where("c <> low").select(F.col("low").alias("a"), F.col("c").alias("b")).distinct())
    # a class goes by its smallest number; its others, in the same buckets, find no partner here
    met = buckets.select("pivot", F.explode("c").alias("no")).where("no <> pivot").groupBy("pivot", "no").agg(F.count("*").alias("shared"))
    by_no = classes.select("no", "c", "n")
    met = met.hint("merge").join(by_no.hint("merge"), "no").join(by_no.toDF("pivot", "p", "m").hint("merge"), "pivot")
    met = durable(met.where("c <> p"))
    best = met.where(_fits(F.col("m"), F.col("n"))).groupBy("c").agg(F.max(F.struct("shared", "p")).alias("x")).select(F.col("x.p").alias("a"), F.col("c").alias("b"))
    links = verified(rows, classes, durable(best))
    found = durable(components(links.union(same)))

    def of(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(found.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    # buckets that still hold several components
    apart = of(of(met.select("pivot", "no", "p", "c"), "p", "cp"), "c", "cc").where("cp <> cc").select("pivot", "no")
    shared = spark.sparkContext.broadcast(_bitmap(apart.mapInArrow(_places, "slot long")))
    open_ = buckets.mapInArrow(_open(shared), "key long, no long")
    own = classes.select("no", "c", "n", *(F.get("sketch", F.lit(k)).alias(f"k{k}") for k in range(8)))
    open_ = durable(of(open_.hint("merge").join(own.hint("merge"), "no").drop("no"), "c", "comp"))
    drop(buckets)
    x, y = open_.alias("x"), open_.alias("y")
    apart_bits = sum((F.bit_count(F.col(f"x.k{k}").bitwiseXOR(F.col(f"y.k{k}"))) for k in range(1, 8)), F.bit_count(F.col("x.k0").bitwiseXOR(F.col("y.k0"))))
    test = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.comp") != F.col("y.comp")) & _fits(F.col("x.n"), F.col("y.n")) & (9 * apart_bits <= F.col("x.n") + F.col("y.n"))
    more = x.join(y, test).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    links = links.union(verified(rows, classes, durable(more)))
    found = durable(components(links.union(same)))
    # a component is called by the smallest doc_id of all its classes
    named = durable(of(classes.select("c", "doc"), "c", "comp"))
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    out = docs.select("doc_id", "n", "c").join(named.join(least, "comp").select("c", "component_id"), "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest doc_id, whole rows.

    Of rows that repeat a doc_id, those with different texts stay and copies of a text go; rows without a doc_id are kept.
    """
    rows = pick(documents, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    stay = near_duplicates(rows).where("doc_id = component_id").groupBy("doc_id").agg((F.count("*") > 1).alias("_many"))
    kept = rows.where("doc_id is not null").join(stay, "doc_id")
    once = kept.where("_many").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"])
    return kept.where("not _many").select(*rows.columns).union(once.select(*rows.columns)).union(rows.where("doc_id is null"))
