"""Language-model scores: unigram counts of all training texts and a hashed maximum-entropy model.

Counts: every task counts its words; (hash, count) pairs are summed over the cluster. The most frequent words, at most
``frequent``, go to every task as sorted arrays; scoring a text needs a join for its other words alone, each once.

Model: classes in classes, down to the tokens: the leaves of a tree that splits 16 ways of even mass, so that a token's
probability is a product of softmax choices, each over sums of weights. Leaves are the end, each of the ``frequent`` words, and groups
of the other words by hash, whose number grows with theirs; in a group, a word's share is its smoothed count, and one
unseen word has a share, so that the whole is a distribution. Features of a choice: a bias, the word before (n-gram), the
word before that (skip), and the word before with the class of that before it; all words have them, hashed into tables
that grow with the training tokens up to 2^``most_bits`` weights each. Training: tasks count how often each way was taken
in each row over all training texts, and the counts are summed over the cluster: the gradient of the log-likelihood at the
start, observed less expected choices, in closed form. The step along it is a smoothed log ratio, and its length a trust
for each feature and each doubling of a row's count, learned by gradient updates that tasks make over all training
texts and that are averaged by how often each trust was met.

Edge cases: null and empty texts are the end token alone; without training texts all counts are 0 and the model is
uniform over its leaves; null ids count as not held out; repeated rows stay; an empty table gives no rows. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, pick
from .hashing import U

#: The end of a text as a token; no word holds a line feed.
END = xxhash.xxh3_64_intdigest(b"\n")
#: Weights or counts that go in one row, tokens that are worked on at once.
PART, STEP = 1 << 12, 4096
#: Tokens whose words are looked up or counted at once, and counts of words that a task keeps.
CHUNK, KEPT = 400_000, 400_000
#: Rows are trusted by how often they were met, in so many steps of doubling; counts are smoothed by so many even ones.
BUCKETS, PRIOR = 16, 6.0


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column, A-Z in lower case, and where those of each row start and the last row's end.

    Arrow parts at ASCII white space only, which is the rule; it leaves empty words at the ends of a text.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = parts.flatten()
    full = pc.not_equal(flat, "")
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), before[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each chunk's words are put together until they are many; a word may come up again in a later part."""

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([h for h, _ in waiting]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([c for _, c in waiting])).astype(np.int64)

    def out(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(h), pa.array(c)], names=["h", "c"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = ends = 0
    for batch in batches:
        words, _ = _words(batch.column("text"))
        ends += batch.num_rows
        for a in range(0, len(words), CHUNK):
            some = words.slice(a, CHUNK).dictionary_encode()
            known = some.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            waiting.append((np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known)), np.bincount(some.indices.to_numpy(), minlength=len(known))))
            size += len(known)
            if size > 2 * KEPT:
                waiting = [merged()]
                if (size := len(waiting[0][0])) > KEPT:
                    yield out(*waiting[0])
                    waiting, size = [], 0
    if ends:
        waiting.append((np.array([END], U), np.array([ends])))
    if waiting:
        yield out(*merged())


def word_counts(training: DataFrame) -> DataFrame:
    """(h, c): each word's hash and count over all training texts, the end token included."""
    return training.select("text").mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


#: What stands before a token, as ``contexts`` has it.
FEATURES = 3
#: Ways at each node of the tree; the weights of a node's ways lie together, one cache line.
WAYS = 16
#: The log-odds of a way that leads nowhere.
NEVER = -60.0


def tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree over leaves, each node split into up to ``WAYS`` parts of about even mass, level by level.

    Returns where each leaf's path starts, the nodes on the paths, the ways taken there, and each node's log shares.
    """
    order = np.argsort(-mass, kind="stable")
    sums = np.concatenate(([0.0], np.cumsum(mass[order])))
    low, high, nodes = np.array([0]), np.array([len(mass)]), 0
    found: list[tuple[np.ndarray, ...]] = []
    odds: list[np.ndarray] = []
    while len(low := low[(wide := high - low > 1)]):
        high = high[wide]
        n, part = high - low, np.arange(1, WAYS)
        # a few leaves have a way each; the first and the last part are never empty, so that each level ends lower
        even = np.searchsorted(sums, sums[low][:, None] + (sums[high] - sums[low])[:, None] * part / WAYS)
        even = np.clip(even, (low + 1)[:, None], (high - 1)[:, None])
        cuts = np.where((n > WAYS)[:, None], even, np.minimum(low[:, None] + part, high[:, None]))
        edges = np.concatenate((low[:, None], cuts, high[:, None]), 1)
        within = sums[edges[:, 1:]] - sums[edges[:, :-1]]
        odds.append(np.where(edges[:, 1:] > edges[:, :-1], np.log(np.maximum(within, 1e-300)) - np.log(sums[high] - sums[low])[:, None], NEVER))
        sizes = np.diff(edges, axis=1).ravel()
        leaves = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        found.append((order[leaves], np.repeat(nodes + np.arange(len(low)), n), np.repeat(np.tile(np.arange(WAYS), len(low)), sizes)))
        nodes += len(low)
        low, high = edges[:, :-1].ravel(), edges[:, 1:].ravel()
    if not found:
        return np.zeros(len(mass) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros((0, WAYS), np.float32)
    leaf, node, way = map(np.concatenate, zip(*found, strict=True))
    by = np.argsort(leaf, kind="stable")
    return np.searchsorted(leaf[by], np.arange(len(mass) + 1)), node[by].astype(np.int32), way[by].astype(np.int8), np.concatenate(odds).astype(np.float32)


@dataclass
class Lexicon:
    """What tasks know of the words; arrays of at most ``frequent`` words, sorted by hash, and the tree."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray  # each word's leaf; leaves are the groups, the end, then words by falling count
    groups: int  # of words not in the arrays, by hash; a power of two
    shares: np.ndarray  # log10 of each group's sum of (c + 1), and 1
    classes: np.ndarray  # of each leaf
    starts: np.ndarray
    nodes: np.ndarray
    ways: np.ndarray
    odds: np.ndarray
    bits: int  # of the hashed tables
    tables: int  # one for each feature
    total: int  # N
    distinct: int  # V
    floor: int  # words with fewer counts are not in the arrays


def lexicon(counts: DataFrame, frequent: int, most_bits: int) -> Lexicon:
    """``frequent`` and ``most_bits`` bound what is collected and sent, whatever the corpus."""
    # counts fall into bins, 64 for each doubling, so that a few thousand rows tell where to cut at any size
    bins = counts.groupBy(F.floor(64 * F.log2("c")).alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("s"), F.min("c").alias("least"), F.max("c").alias("most")).collect()
    total, distinct = sum(r.s for r in bins), sum(r.n for r in bins)
    floor, room = max((r.most for r in bins), default=0) + 1, frequent
    for r in sorted(bins, key=lambda r: -r.bin):
        if r.n > room:
            break
        floor, room = r.least, room - r.n
    got = counts.where(F.col("c") >= floor).toArrow()
    h, c = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    # about 16 of the other words in a group
    groups = 1 << int(np.log2(max(1, min(frequent, (distinct - len(h)) // 16))))
    sums = np.ones(groups)
    others = counts.where(F.col("c") < floor).groupBy(F.col("h").bitwiseAND(groups - 1).alias("g")).agg(F.sum(F.col("c") + 1).alias("s")).toArrow()
    sums[others["g"].to_numpy()] += others["s"].to_numpy()
    best = np.lexsort((h, -c))
    best = best[h[best] != U(END)]
    ids = np.full(len(h), groups, np.int32)
    ids[best] = groups + 1 + np.arange(len(best))
    mass = np.concatenate((sums, [c[h == U(END)].sum() + 1.0], c[best] + 1.0))
    # classes of even mass for words by falling count; the groups are one, the end another
    n_classes = max(1, round(len(best) ** 0.5))
    before = np.cumsum(c[best]) - c[best]
    classes = np.concatenate((np.zeros(groups, np.int64), [1], 2 + (before * n_classes // max(1, int(c[best].sum()))).astype(np.int64)))
    bits = int(min(most_bits, max(12, np.ceil(np.log2(4.0 * (total + 1))))))
    return Lexicon(h, c, ids, groups, np.log10(sums), classes, *tree(mass), bits, FEATURES, total, distinct, floor)


class Reader:
    """Texts to slots: numbers of words as they come up in a chunk, with what the lexicon says of each."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.hashes = np.array([END], U)
        self.at = self._find(self.hashes)

    def _find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.lex.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.lex.hashes, h), len(self.lex.hashes) - 1)
        return np.where(self.lex.hashes[at] == h, at, -1)

    def chunks(self, batch: pa.RecordBatch, tokens: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, slots of all, start of each text), a bounded number of tokens or one text at a time.

        A text's slots are those of its words and the end (slot 0). Each word of a chunk is looked up once.
        """
        words, at = _words(batch.column("text"))
        until = at + np.arange(len(at))  # with the ends
        first = 0
        while first < batch.num_rows:
            last = min(int(np.searchsorted(until, until[first] + tokens)), batch.num_rows)
            some = words.slice(at[first], at[last] - at[first]).dictionary_encode()
            known = some.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            self.hashes = np.fromiter((END, *map(xxhash.xxh3_64_intdigest, known)), np.uint64, len(known) + 1)
            self.at = self._find(self.hashes)
            places = until[first : last + 1] - until[first]
            slots = np.zeros(places[-1], np.int64)
            inside = np.ones(len(slots), bool)
            inside[places[1:] - 1] = False
            slots[inside] = some.indices.to_numpy() + 1
            yield first, last - first, slots, places[:-1]
            first = last

    def leaves(self, slots: np.ndarray) -> np.ndarray:
        group = (self.hashes & U(self.lex.groups - 1)).astype(np.int64)
        known = np.where(self.at >= 0, self.lex.ids[np.maximum(self.at, 0)] if len(self.lex.ids) else 0, group)
        known[0] = self.lex.groups
        return known[slots]


def contexts(hashes: np.ndarray, leaves: np.ndarray, starts: np.ndarray, lex: Lexicon) -> np.ndarray:
    """Three hashes of what stands before each token: the word, the one before it, the word with that one's class.

    Texts begin after ends: a text's second token follows its first, and what stands two before it is the end.
    """
    before = lambda x, end, k: np.concatenate((np.full(k, end, x.dtype), x[:-k]))[: len(x)]
    one, two, kind = before(hashes, END, 1), before(hashes, END, 2), before(lex.classes[leaves], 1, 2)
    one[starts] = END
    second = starts + 1
    for at in (starts, second[second < len(leaves)]):
        two[at], kind[at] = END, 1
    return np.stack((one * U(0x9E3779B97F4A7C15), two * U(0xC2B2AE3D27D4EB4F) + U(1), (one ^ (kind.astype(U) + U(2)) * U(0x165667B19E3779F9)) * U(0xD6E8FEB86659FD93)))


def powers(z: np.ndarray) -> None:
    """e to the scores, in their place; scores above 80 would leave the range of single precision with their sum."""
    if len(z) and z.max() > 80:
        np.minimum(z, 80, out=z)
    np.exp(z, out=z)


class Tree:
    """Softmax choices down the tree; weights: hashed tables in rows of ``WAYS``, added to the nodes' log shares."""

    def __init__(self, lex: Lexicon, weights: np.ndarray | None = None):
        self.lex = lex
        self.weights = np.zeros(lex.tables << lex.bits, np.float32) if weights is None else weights
        self.nodes, self.ways = lex.nodes.astype(np.int64), lex.ways.astype(np.int64)
        self.mixed = (self.nodes.astype(U) + U(1)) * U(0xFF51AFD7ED558CCD)

    def choices(self, context: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all choices on the way to each token's leaf: the token's place, its rows of weights, node and way."""
        lex = self.lex
        first = lex.starts[leaves]
        n = lex.starts[leaves + 1] - first
        of = np.repeat(np.arange(len(leaves)), n)
        at = np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n)
        mixed = context.take(of, 1)
        mixed ^= self.mixed.take(at)
        mixed *= U(0xC4CEB9FE1A85EC53)
        mixed >>= U(68 - lex.bits)
        rows = mixed.view(np.int64)
        rows += np.arange(len(context))[:, None] << (lex.bits - 4)
        return of, rows, self.nodes.take(at), self.ways.take(at)

    def shares(self, rows: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all ways at each choice as powers of e, and the sums of those."""
        z = self.lex.odds.take(node, 0)
        table = self.weights.reshape(-1, WAYS)
        for row in rows:
            z += table.take(row, 0)
        powers(z)
        return z, z @ np.ones(WAYS, np.float32)

    def log_probs(self, context: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Natural logs of the tokens' leaves."""
        of, rows, node, way = self.choices(context, leaves)
        if not len(of):
            return np.zeros(len(leaves))
        e, whole = self.shares(rows, node)
        logs = np.log(np.maximum(e[np.arange(len(of)), way], 1e-35)) - np.log(whole)
        return np.bincount(of, weights=logs, minlength=len(leaves))


def logs(counts: np.ndarray) -> np.ndarray:
    """Rows of counts of ways as smoothed log ratios to even shares."""
    return np.log((counts + PRIOR / WAYS) / ((counts.sum(-1, keepdims=True) + PRIOR) / WAYS))


def bucket(n: np.ndarray) -> np.ndarray:
    """Of rows by how often they were met: the number of binary digits, at most BUCKETS - 1."""
    return np.minimum(np.log2(n + 1.0), BUCKETS - 1).astype(np.int64)


def weights_of(counts: np.ndarray, trust: np.ndarray, bits: int) -> np.ndarray:
    """The tables of weights from summed counts; trust: features by buckets."""
    out = np.empty(len(counts), np.float32)
    for a in range(0, len(counts), PART):  # a part lies in one table
        rows = counts[a : a + PART].reshape(-1, WAYS)
        out[a : a + PART] = (logs(rows) * trust[a >> bits][bucket(rows.sum(1))][:, None]).ravel()
    return out


def _observe(lex_: object):
    """Texts to (part, w): how often each way was taken in each row, in parts of ``PART`` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lex_.value
        reader, model = Reader(lex), Tree(lex)
        seen = np.zeros(lex.tables << lex.bits, np.uint32)
        for batch in batches:
            for _, _, slots, starts in reader.chunks(batch):
                leaves = reader.leaves(slots)
                context = contexts(reader.hashes[slots], leaves, starts, lex)
                for a in range(0, len(leaves), STEP):
                    _, rows, _, way = model.choices(context[:, a : a + STEP], leaves[a : a + STEP])
                    for row in rows:
                        np.add.at(seen, row * WAYS + way, np.uint32(1))
        for part, a in enumerate(range(0, len(seen), PART)):
            if (some := seen[a : a + PART]).any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([some.astype(np.uint16 if some.max() < 1 << 16 else np.uint32).tobytes()], pa.binary())], names=["part", "w"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("w"), strict=True):
            w = np.frombuffer(raw.as_buffer(), np.uint16 if len(raw.as_buffer()) == 2 * PART else np.uint32)
            sums.setdefault(part, np.zeros(PART, np.float64))
            sums[part] += w
    for part, w in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["part", "w"])


def _update(lex_: object, rows_: object, trust: np.ndarray, rate: float):
    """Texts to (k, w, n): where gradient steps take each trust, and by how many steps it was met.

    rows_: logs of the smoothed counts, and each row's bucket without one count, as ``prepared`` has them. A token's own
    count is taken off the rows that it looks up, so that they speak as for a text not seen. Rows go by the logs of their
    smoothed counts: what is the same for all ways changes neither choices nor slopes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, (table, kind) = lex_.value, rows_.value
        reader, model, ones = Reader(lex), Tree(lex, table), np.ones(WAYS, np.float32)
        table = table.reshape(-1, WAYS)
        now, squares, met = trust.astype(np.float64), np.full(trust.shape, 1e-3), np.zeros(trust.shape)
        for batch in batches:
            for _, _, slots, starts in reader.chunks(batch):
                leaves = reader.leaves(slots)
                context = contexts(reader.hashes[slots], leaves, starts, lex)
                for a in range(0, len(leaves), STEP):
                    _, rows, node, way = model.choices(context[:, a : a + STEP], leaves[a : a + STEP])
                    if not len(way):
                        continue
                    kinds = [kind.take(row) for row in rows]
                    by, slopes = now.astype(np.float32), np.zeros(trust.shape)
                    for first in range(0, len(way), STEP):  # a part fits the processor's cache
                        part = slice(first, first + STEP)
                        own = np.arange(len(way[part])) * WAYS + way[part]
                        z, said, mine = lex.odds.take(node[part], 0), [], []
                        for f, row in enumerate(rows):
                            others = table.take(row[part], 0)
                            flat = others.ravel()
                            mine.append(flat.take(own))
                            mine[f] += np.log1p(-np.exp(-mine[f]))
                            flat[own] = mine[f]
                            said.append(others)
                            z += np.repeat(by[f].take(kinds[f][part]), WAYS).reshape(z.shape) * others
                        powers(z)
                        whole = z @ ones
                        for f in range(len(rows)):
                            said[f] *= z
                            slopes[f] += np.bincount(kinds[f][part], mine[f] - said[f] @ ones / whole, BUCKETS)
                    for f in range(len(rows)):
                        slope = slopes[f] / len(way)
                        squares[f] += slope**2
                        now[f] += rate * slope / np.sqrt(squares[f])
                        met[f] += np.bincount(kinds[f], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(now.size)), pa.array((now * met).ravel()), pa.array(met.ravel())], names=["k", "w", "n"])

    return run


def prepared(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``_update``: logs of the smoothed counts, and of each row the bucket that it has without one count."""
    out = counts + np.float32(PRIOR / WAYS)
    return np.log(out, out=out), bucket(np.maximum(counts.reshape(-1, WAYS) @ np.ones(WAYS, np.float32) - 1, 0)).astype(np.uint8)


def train(training: DataFrame, lex: Lexicon, lex_: object, rounds: int, rate: float = 0.1) -> Tree:
    """All training texts give the counts; ``rounds`` of updates of the trusts go over all of them as well."""
    model = Tree(lex)
    if not lex.total or not lex.odds.size:
        return model
    # a task goes over about as many tokens as a table has weights, so that what tasks send follows the corpus
    tasks = min(training.rdd.getNumPartitions(), max(1, lex.total >> lex.bits))
    seen = training.coalesce(tasks).mapInArrow(_observe(lex_), "part int, w binary").repartition("part").mapInArrow(_summed, "part int, w binary")
    counts = model.weights
    for r in durable(seen).toLocalIterator():
        counts[r.part * PART : (r.part + 1) * PART] = np.frombuffer(bytes(r.w), np.float32)
    trust = np.full((lex.tables, BUCKETS), 0.4)
    sent = training.sparkSession.sparkContext.broadcast(prepared(counts))
    for _ in range(rounds):
        moved = training.mapInArrow(_update(lex_, sent, trust, rate), "k long, w double, n double").groupBy("k").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        for r in moved.where("n > 0").collect():  # features by buckets
            trust[r.k // BUCKETS, r.k % BUCKETS] = r.w / r.n
    sent.unpersist()
    model.weights = weights_of(counts, trust, lex.bits)
    return model


class Model:
    """The plain two-level form, class and token within its class, with all weights at hand; for small vocabularies."""

    def __init__(self, classes: np.ndarray, n_classes: int, hashed: int, weights: np.ndarray | None = None):
        self.classes, self.n_classes, self.size, self.hashed = classes, n_classes, len(classes), hashed
        self.rows = 1 + self.size + n_classes + hashed
        self.weights = np.zeros((self.rows, n_classes + self.size), np.float32) if weights is None else weights
        self.order = np.argsort(classes, kind="stable")
        present, self.starts = np.unique(classes[self.order], return_index=True)
        self.present = present
        self.inverse = np.argsort(self.order)
        self.group = np.searchsorted(present, classes)

    def features(self, context: np.ndarray) -> np.ndarray:
        one, two = context // self.n_classes, context % self.n_classes
        mixed = ((one * 1_000_003 + two * 7_919 + 1) * 2_654_435_761 >> 7) % self.hashed
        return np.stack((np.zeros_like(one), 1 + one, 1 + self.size + two, 1 + self.size + self.n_classes + mixed), 1)

    def log_probs(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs: of the classes that have tokens, and of each token within its class; a row for each context."""
        z = self.weights[self.features(context)].sum(1).astype(np.float64)
        c = z[:, self.present]
        c = c - np.logaddexp.reduce(c, axis=1, keepdims=True)
        w = z[:, self.n_classes :]
        whole = np.logaddexp.reduceat(w[:, self.order], self.starts, axis=1)
        return c, w - whole[:, self.group]

    def gradient(self, context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the log-likelihood of next-token counts (contexts by tokens), and that itself."""
        c, w = self.log_probs(context)
        by_class = np.add.reduceat(counts[:, self.order], self.starts, axis=1)
        fit = float((by_class * c).sum() + (counts * w).sum())
        error = np.zeros((len(context), self.n_classes + self.size), np.float32)
        error[:, self.present] = by_class - by_class.sum(1, keepdims=True) * np.exp(c)
        error[:, self.n_classes :] = counts - by_class[:, self.group] * np.exp(w)
        out = np.zeros_like(self.weights)
        for column in self.features(context).T:
            np.add.at(out, column, error)
        return out, fit


SCORES = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
SCORES_DDL = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>, times array<long>"


def _score(lex_: object, weights_: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, uid = lex_.value, TaskContext.get().partitionId() << 40
        reader, model = Reader(lex), Tree(lex, weights_.value)
        below = np.log10(lex.total + lex.distinct + 1.0)
        for batch in batches:
            for first, rows, slots, starts in reader.chunks(batch):
                at = reader.at
                known = at >= 0
                count = np.where(known, lex.counts[np.maximum(at, 0)] if len(lex.counts) else 0, 0)
                known[0], end = True, count[0]  # the end is never looked up again
                lg = np.where(known, np.log10(count + 1.0), 0.0)
                leaves = reader.leaves(slots)
                context = contexts(reader.hashes[slots], leaves, starts, lex)
                logs = np.concatenate([model.log_probs(context[:, a : a + STEP], leaves[a : a + STEP]) for a in range(0, len(leaves), STEP)]) / np.log(10)
                inside, grouped = lg[slots], leaves < lex.groups
                logs[grouped] += (inside - lex.shares[np.minimum(leaves, lex.groups - 1)])[grouped]
                sums = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                n = np.diff(np.append(starts, len(slots)))
                of = np.repeat(np.arange(rows), n)
                rare = ~known[slots]
                pair, times = np.unique((of[rare] << 32) | slots[rare], return_counts=True)
                ends = np.searchsorted(pair >> 32, np.arange(rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (_signed(reader.hashes[pair & 0xFFFFFFFF]), pa.array(times.astype(np.int64)))]
                seen = known.copy()
                seen[0] = end > 0
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(rows)), part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(sums(seen[slots].astype(np.int64))), pa.array(sums(inside - below)), pa.array(sums(logs)), *lists],
                    schema=SCORES,
                )
                uid += rows

    return run


def score(documents: DataFrame, frequent: int = 1 << 18, most_bits: int = 22, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``documents``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = pick(documents, doc_id="bigint", text="string").withColumn("held_out", held_out(F.col("doc_id")))
    training = rows.where("not held_out").select("text")
    counts = durable(word_counts(training))
    lex = lexicon(counts, frequent, most_bits)
    shared = spark.sparkContext.broadcast(lex)
    weights = spark.sparkContext.broadcast(train(training, lex, shared, rounds).weights)
    scored = durable(rows.mapInArrow(_score(shared, weights), SCORES_DDL))
    others = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    low = counts.where(F.col("c") < lex.floor)
    found = others.hint("merge").join(low, "h", "left")
    lifted = found.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("lift"))
    out = scored.drop("rare", "times").join(lifted.hint("merge"), "uid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("lift", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("lift", F.lit(0.0))).alias("score"),
    )
