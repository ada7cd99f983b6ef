"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter of its character trigrams; the filters lie side by side, bit-sliced: a slot holds a
mask with a bit for each language, so that one lookup, the AND of a trigram's slots, returns all languages that
contain it. Over a text, the bits set for a language are counted, the expected false positives (the filter's fill to
the power of the hash functions) are taken off, and the largest count decides.

A trigram is put into the filter of a language if its rate there is at least ``share`` of its highest rate in any. Tasks
fill filters of their own and the cluster ORs them. All trigrams are put in; ``most_slots`` bounds the slots alone, and
fuller filters have more false positives, which the counts are corrected for.

Training takes a sample: of each language, the documents whose doc_id hashes below a bound that leaves about
``max_docs`` (the language's own number of documents sets it). Prediction reads whole texts.

Edge cases: null texts and texts without a letter are ``und`` with score 0; so is all if no language was learned; ties
go to the language with more training documents, then by name; a text none of whose trigrams is known gets that
language too; null doc_ids are not held out; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, pick
from .hashing import U, mix64

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trigrams of words, their ends marked; and the number of each word's first one."""
    codes = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le"), np.uint32).astype(U)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inside = b != U(95)
    h = mix64((a << U(42)) ^ (b << U(21)) ^ c)[inside]
    return h, np.cumsum([0, *map(len, words[:-1])])  # a word has a trigram for each letter, the one in its middle


@dataclass
class Filters:
    """Bit-sliced Bloom filters; languages in order of training documents, then name."""

    languages: list[str]
    masks: np.ndarray  # slots by mask words
    hashes: int
    wrong: np.ndarray  # chance of a false positive, by language

    @classmethod
    def empty(cls, languages: list[str], grams: int, bits_each: int = 10, hashes: int = 4, most_slots: int = 1 << 22) -> Filters:
        slots = 1 << min(most_slots.bit_length() - 1, max(10, int(bits_each * max(1, grams) - 1).bit_length()))
        return cls(languages, np.zeros((slots, -(-max(1, len(languages)) // 64)), U), hashes, np.zeros(len(languages)))

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, members: np.ndarray, **options: int) -> Filters:
        """members: trigrams by languages, boolean."""
        out = cls.empty(languages, len(grams), **options)
        out.put(grams, members)
        return out.measured()

    def put(self, grams: np.ndarray, members: np.ndarray) -> None:
        for k in range(len(self.languages)):
            for at in self.places(grams[members[:, k]]).T:
                self.masks[at, k // 64] |= U(1) << U(k % 64)  # equal places get equal bits

    def measured(self) -> Filters:
        """With the chances of false positives that the filters' fill gives."""
        for k in range(len(self.languages)):
            self.wrong[k] = float(((self.masks[:, k // 64] >> U(k % 64)) & U(1)).mean()) ** self.hashes
        return self

    def places(self, h: np.ndarray) -> np.ndarray:
        step = (h >> U(32)) | U(1)
        return np.stack([((h + U(k) * step) & U(len(self.masks) - 1)).astype(np.int64) for k in range(self.hashes)], 1)

    def containing(self, h: np.ndarray) -> np.ndarray:
        """For each trigram the mask words of all languages that contain it."""
        return np.bitwise_and.reduce(self.masks[self.places(h)], axis=1)

    def votes(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Counts by language of the trigrams from each start to the next."""
        found = self.containing(h)
        return np.stack([np.add.reduceat((found[:, k // 64] >> U(k % 64)) & U(1), starts) for k in range(len(self.languages))], 1).astype(np.int64)

    def decide(self, votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and the score for rows of votes over n trigrams."""
        true = np.maximum(0, (votes - n[:, None] * self.wrong) / np.maximum(1e-9, 1 - self.wrong))
        best = true.argmax(1)
        return best, (true[np.arange(len(best)), best] + 1 / len(self.languages)) / (true.sum(1) + 1)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in words.items():
            if not counts:
                continue
            h, starts = trigrams(list(counts))
            n = np.repeat(list(counts.values()), np.diff(np.append(starts, len(h))))
            keys, back = np.unique(h, return_inverse=True)
            sums = np.bincount(back, weights=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(sums)], names=["lang", "h", "n"])

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            words.setdefault(lang, Counter()).update(WORDS.findall(text.as_py().lower()))
        if sum(map(len, words.values())) > 300_000:
            yield from out(words)
            words = {}
    yield from out(words)


#: Mask words that go in one row.
PART = 1 << 12


def _fill(filters: Filters):
    """Trigrams and the languages they belong to (h, members) to (part, w): a task's filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(filters.languages, np.zeros(filters.masks.shape, U), filters.hashes, filters.wrong)
        for batch in batches:
            if batch.num_rows:
                members = np.stack([np.asarray(batch.column(f"l{k}").to_numpy(zero_copy_only=False), bool) for k in range(len(own.languages))], 1)
                own.put(batch.column("h").to_numpy().view(U), members)
        flat = own.masks.ravel()
        for part, a in enumerate(range(0, len(flat), PART)):
            if (some := flat[a : a + PART]).any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([some.tobytes()], pa.binary())], names=["part", "w"])

    return run


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("w"), strict=True):
            w = np.frombuffer(raw.as_buffer(), U)
            found[part] = found[part] | w if part in found else w.copy()
    for part, w in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([w.tobytes()], pa.binary())], names=["part", "w"])


def train(training: DataFrame, max_docs: int = 4000, most_slots: int = 1 << 22, share: float = 0.3) -> Filters:
    """Filters from rows (doc_id, text, lang); null lang or text teaches nothing.

    ``max_docs``: documents of each language in the sample, about. ``most_slots``: bound of the filters' slots.
    """
    rows = training.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Filters.empty([], 0)
    part = F.lit(0.0)
    for lang in languages:
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs / sizes[lang]))).otherwise(part)
    # rows without an id are told apart by their texts
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    sample = rows.where(F.pmod(key, F.lit(1 << 20)) < part * (1 << 20))
    sums = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, h long, n long").groupBy("h").pivot("lang", languages).agg(F.sum("n"))
    names = [f"l{k}" for k in range(len(languages))]
    got = durable(sums.toDF("h", *names).fillna(0, names))
    whole = got.agg(F.count("*").alias("grams"), *(F.sum(n).alias(n) for n in names)).collect()[0]
    filters = Filters.empty(languages, whole.grams, most_slots=most_slots)
    rates = [F.col(n) / F.lit(float(max(1, whole[n] or 0))) for n in names]
    top = F.greatest(*rates) if len(rates) > 1 else rates[0]
    members = got.select("h", *[((r > 0) & (r >= share * top)).alias(n) for n, r in zip(names, rates, strict=True)])
    filled = members.mapInArrow(_fill(filters), "part int, w binary").repartition("part").mapInArrow(_either, "part int, w binary")
    flat = filters.masks.reshape(-1)
    for r in durable(filled).toLocalIterator():  # as many bytes as the filters have
        flat[r.part * PART : (r.part + 1) * PART] = np.frombuffer(bytes(r.w), U)
    return filters.measured()


def _predict(shared: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        width = len(filters.languages)
        slots: dict[str, int] = {}
        votes, n, letters = np.zeros((0, width), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

        def settle(fresh: list[str]) -> None:
            nonlocal votes, n, letters
            for a in range(0, len(fresh), 50_000):
                words = fresh[a : a + 50_000]
                h, starts = trigrams(words)
                votes = np.concatenate((votes, filters.votes(h, starts)))
                n = np.concatenate((n, np.diff(np.append(starts, len(h)))))
                letters = np.concatenate((letters, np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))))

        for batch in batches:
            docs, fresh = [], []
            for text in batch.column("text"):
                words = WORDS.findall((text.as_py() or "").lower()) if width else []
                for w in set(words):
                    if w not in slots:
                        slots[w] = len(slots)
                        fresh.append(w)
                docs.append(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)))
            settle(fresh)
            sums = np.stack([votes[d].sum(0) for d in docs]) if width else np.zeros((len(docs), 0), np.int64)
            sizes = np.array([int(n[d].sum()) for d in docs], np.int64)
            some = np.array([bool(letters[d].any()) for d in docs], bool)
            if width:
                best, score = filters.decide(sums, sizes)
                named = [filters.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            else:
                named, score = [UNKNOWN] * len(docs), np.zeros(len(docs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(np.where(some, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])
            if len(slots) > 300_000:
                slots.clear()
                votes, n, letters = votes[:0], n[:0], letters[:0]

    return run


def predict(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for rows (doc_id, held_out, text); whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)
    return documents.select("doc_id", "held_out", "text").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, **options: float) -> DataFrame:
    """Learns from the documents that are not held out and predicts for all."""
    bounded_batches(documents.sparkSession)
    rows = pick(documents, doc_id="bigint", text="string", lang="string").withColumn("held_out", held_out(F.col("doc_id")))
    return predict(rows, train(rows.where("not held_out"), **options))
