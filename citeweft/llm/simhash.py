"""Near-duplicates by SimHash, found by a self-join of binary tries.

A fingerprint has a bit set where over half of a text's 4-word shingles, repeats included, have it set in their XXH64 (seed
42). Texts of fewer words are one shingle; a text without words has the fingerprint zero. Fingerprints link at ``DISTANCE``
or fewer differing bits.

Equal fingerprints are one from the start. The 64 bits are cut into blocks; whatever DISTANCE blocks the differing bits
are in, the other blocks agree, so each choice of blocks that agree deals the fingerprints into groups: five blocks and
five choices of one block, or, as fingerprints grow more, more blocks and longer keys, so that groups stay small. A group
beyond ``MOST`` fingerprints is cut into chunks, and every two of them are a tile that is joined by itself.

A task holds the tries of its groups: sorted fingerprints, where a node is a range, its bits above the first that differs
within are common to all in it, and it splits at that bit. Pairs of nodes are traversed together, from each root with
itself: the differing bits of what both have in common are counted, the pair goes once they exceed the budget, and else
the node with the higher split is replaced by its two halves. Pairs of leaves that are left are links. The frontier of
pairs is an array; blocks of it are worked off depth-first, so that memory is bounded. The budget rises from one bit to
DISTANCE, and links join components at once: a pair of nodes that lie in one component goes, so a dense heap of near copies
is not compared pair by pair. A task sends one link for each fingerprint that is not the least of its component there.

Edge cases: null and empty texts have the fingerprint zero and link as any other; rows with one doc_id count as one
document, so their fingerprints are tied; a null doc_id is a document of its own, whose component is the smallest id it
reaches, or null; repeated rows stay; an empty table gives no rows; further columns are dropped. Long texts are read in
blocks. Arrow batches are bounded by bytes, a setting of the session that stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, pick
from .components import components
from .hashing import U, mix64, texts

DISTANCE, SHINGLE, SEED = 4, 4, 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes from which a text is read in blocks, and words of a block.
LARGE, WORDS = 1 << 20, 1 << 16
#: Fingerprints of a group that one task joins; of a group on average; of a task's groups together.
MOST, USUAL, TASK = 1 << 20, 1 << 11, 1 << 21
#: Large groups whose sizes go to every task; more of them are joined.
FEW = 100_000
#: Pairs of nodes that are worked on at a time, and links that wait to be joined.
PAIRS, LINKS = 1 << 18, 1 << 17


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in blocks that overlap by one shingle less a word."""
    if len(text) < LARGE:
        yield text.split()
        return
    found, block = (m[0] for m in WORD.finditer(text)), []
    while new := list(islice(found, WORDS)):
        block = block[1 - SHINGLE :] + new
        yield block


def fingerprint(text: bytes | None) -> int:
    """A text's 64 bits."""
    ones, n = np.zeros(64, np.int64), 0
    for words in _blocks(text.lower()) if text else ():
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        if len(words) > SHINGLE:
            starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        pieces = (joined[a:b] for a, b in zip(starts.tolist(), (ends - 1).tolist(), strict=True))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), U, len(starts))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):
            ones += bits[a : a + 255].sum(axis=0, dtype=np.uint8)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(U)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter(map(fingerprint, texts(batch.column("text"))), U, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def cut(mask: int, blocks: int) -> list[int]:
    """The set bits of a mask in blocks of like size, as masks."""
    bits = [b for b in range(64) if mask >> b & 1]
    parts = np.array_split(bits, min(blocks, len(bits)))
    return [sum(1 << int(b) for b in p) for p in parts]


def choices(n: int) -> list[int]:
    """Masks of the bits that may agree, enough of them for groups of some USUAL out of n fingerprints."""
    for blocks in range(DISTANCE + 1, 2 * DISTANCE + 1):
        if n >> (64 * (blocks - DISTANCE) // blocks) <= USUAL:
            break
    return [sum(c) for c in combinations(cut(2**64 - 1, blocks), blocks - DISTANCE)]


def _key(fp: np.ndarray, mask: np.uint64) -> np.ndarray:
    return mix64(mix64(fp & mask) ^ mix64(np.array([mask]) + U(0x9E3779B97F4A7C15))).view(np.int64)


GROUPS = "key long, fp long"


def _grouped(masks: list[int]):
    """Fingerprints to their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array(batch.column("fp"), np.int64)
            for mask in masks:
                yield pa.RecordBatch.from_arrays([pa.array(_key(fp.view(U), U(mask))), pa.array(fp)], names=["key", "fp"])

    return run


def _tiled(groups: DataFrame, most: int) -> DataFrame:
    """Groups (key, fp) with those beyond ``most`` fingerprints in tiles of two chunks each, under keys of their own."""
    sizes = groups.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = durable(sizes.select("key", F.ceil(2 * F.col("n") / most).cast("int").alias("chunks")))
    n = large.count()
    if not n:
        return groups
    large = F.broadcast(large) if n <= FEW else large
    chunk = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    rows = groups.join(large, "key", "left").withColumn("chunk", chunk)
    other = F.when(F.col("chunks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.select("key", "fp", "chunk", F.explode(other).alias("other"))
    tile = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return rows.select(F.when(F.col("other").isNull(), F.col("key")).otherwise(tile).alias("key"), "fp")


class Tries:
    """The binary tries of sorted fingerprints in groups. Node k is the range low[k] to high[k] and splits at bit split[k].

    split is -1 for a leaf; one[k] is the child whose bit is set, zero[k] the other; value[k] is a fingerprint below.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
        low, high = starts, np.append(starts[1:], len(group))[: len(starts)]
        self.roots = np.arange(len(starts))
        lows, highs, splits, zeros, ones, known = [], [], [], [], [], len(starts)
        while len(low):
            apart = fp[low] ^ fp[high - 1]
            # the highest bit that differs: smeared down, then counted
            for k in (1, 2, 4, 8, 16, 32):
                apart = apart | (apart >> U(k))
            split = np.bitwise_count(apart).astype(np.int64) - 1
            inner = np.flatnonzero(split >= 0)
            a, b, bit = low[inner], high[inner] - 1, split[inner].astype(U)
            while (todo := b - a > 1).any():  # the first with the bit set, by halves
                middle = (a + b) >> 1
                is_set = (fp[middle] >> bit & U(1)).astype(bool)
                a, b = np.where(todo & ~is_set, middle, a), np.where(todo & is_set, middle, b)
            zero, one = np.full(len(low), -1), np.full(len(low), -1)
            zero[inner] = known + 2 * np.arange(len(inner))
            one[inner] = zero[inner] + 1
            for kept, new in ((lows, low), (highs, high), (splits, split), (zeros, zero), (ones, one)):
                kept.append(new)
            low, high = np.column_stack((low[inner], b)).ravel(), np.column_stack((b, high[inner])).ravel()
            known += 2 * len(inner)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.low, self.high, self.split, self.zero, self.one = map(join, (lows, highs, splits, zeros, ones))
        self.value = fp[self.low]

    def met(self, a: np.ndarray, b: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes whose common bits differ in the budget at most."""
        at = np.maximum(self.split[a], self.split[b])
        apart = self.value[a] ^ self.value[b]
        apart = np.where(at < 63, apart >> np.minimum(at + 1, 63).astype(U), U(0))
        ok = (a == b) | (np.bitwise_count(apart) <= budget)
        return a[ok], b[ok]

    def parted(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes with the higher of both in halves; a node with itself gives its halves with themselves and each other."""
        own = a == b
        same, x, y = a[own], a[~own], b[~own]
        higher = self.split[x] >= self.split[y]
        up, down = np.where(higher, x, y), np.where(higher, y, x)
        same = same[self.split[same] >= 0]
        z, o = self.zero[same], self.one[same]
        return np.concatenate((z, o, z, self.zero[up], self.one[up])), np.concatenate((z, o, o, down, down))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each names one of its own, the least) with the components of a and b made one."""
    while True:
        x, y = label[a], label[b]
        new = x != y
        if not new.any():
            return label
        a, b, x, y = a[new], b[new], x[new], y[new]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def linked(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (a, b) that make the components of the fingerprints in groups, and the pairs of nodes it took."""
    order = np.lexsort((fp, group))
    group, fp = group[order], fp[order]
    names, of = np.unique(fp, return_inverse=True)
    tries, label, seen = Tries(group, fp), np.arange(len(names)), 0
    for budget in range(1, DISTANCE + 1):
        one = marks = None
        stack, found, waiting = [(tries.roots, tries.roots)], [], 0
        while stack or waiting:
            if waiting > LINKS or not stack:
                a, b = (of[tries.low[np.concatenate(x)]] for x in zip(*found, strict=True))
                label, found, waiting, one = _joined(label, a, b), [], 0, None
                continue
            if one is None:  # which nodes lie in one component, and in which
                marks = label[of]
                changes = np.cumsum(np.concatenate(([False], marks[1:] != marks[:-1])))
                one = np.where(changes[tries.low] == changes[tries.high - 1], marks[tries.low], -1)
            a, b = stack.pop()
            seen += len(a)
            a, b = tries.met(a, b, budget)
            apart = (one[a] < 0) | (one[a] != one[b])
            a, b = a[apart], b[apart]
            leaf = (tries.split[a] < 0) & (tries.split[b] < 0)
            if leaf.any():
                found.append((a[leaf & (a != b)], b[leaf & (a != b)]))
                waiting += len(found[-1][0])
                a, b = a[~leaf], b[~leaf]
            a, b = tries.parted(a, b)
            stack += [(a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
    away = np.flatnonzero(label != np.arange(len(names)))
    return names[label[away]], names[away], seen


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups to links of their fingerprints."""
    groups, fps = [], []
    for batch in batches:
        groups.append(np.array(batch.column("key"), np.int64))
        fps.append(np.array(batch.column("fp"), np.int64).view(U))
    if fps:
        a, b, _ = linked(np.concatenate(groups), np.concatenate(fps))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(fingerprints: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) between fingerprints that make the components of all. fingerprints (fp), distinct and durable."""
    n = fingerprints.count()
    if not n:
        return fingerprints.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    groups = _tiled(durable(fingerprints.mapInArrow(_grouped(choices(n)), GROUPS)), most)
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(groups.repartition(max(parts, -(-len(choices(n)) * n // TASK)), "key").mapInArrow(_links, "a long, b long"))


def near_duplicates(documents: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``documents``; ``most`` bounds the groups of a task."""
    bounded_batches(documents.sparkSession)
    rows = pick(documents, doc_id="bigint", text="string")
    docs = durable(rows.mapInArrow(_fingerprints, "doc_id long, fp long"))
    classes = durable(docs.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    # documents that stand in several rows tie their fingerprints
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    tied = docs.join(ids, "doc_id").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    found = durable(components(links(classes.select("fp"), most).union(tied)))
    named = classes.join(found.toDF("fp", "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    of = durable(named.join(least, "comp").select("fp", "component_id"))
    return docs.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
