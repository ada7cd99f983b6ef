"""Packing tokens into sequences, with the mixture of sources under control in every window.

Each source's documents form a queue of token ids. The stream of sequences is made window by window; in a window every
source that is not exhausted gets its quantum, its share of the window, plus the deficit it carries: what it was owed
before and could not be given in whole tokens. That deficit round-robin has a closed form: after k windows a source
has given the floor of its credit after k windows, so any task can work out, for itself, where a token goes; deficits
are carried across windows and partitions alike. Sequences are cut from the whole stream, so that only the last one
may be short.

Steps: tokenize once, with each document's place within its partition and source; sum by partition and source;
add the sums up to the partitions' places in the queues; cut pieces. Token ids are written once and never shuffled,
unless the table of partition sums is too large to broadcast.

Edge cases: null and empty texts are the end id alone; a null source is a queue of its own, last in order; repeated
rows and null ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, durable, pick

END_ID = 0
TOKENIZER = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def encoder(name: str, specials: bool = True) -> Callable[[str], np.ndarray]:
    """text -> ids of a byte-level BPE in a tokenizers file, worked out by tiktoken from the same vocabulary.

    A byte-level BPE whose merges have their ids in order, whose pre-tokenizer is the usual byte-level split and
    which normalises nothing, is what tiktoken runs, at several times the speed; any other file goes to tokenizers itself. Strings of
    special tokens in a text are their ids, as in a plain call, or ordinary text without ``specials``.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not specials

    def plain(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    before = whole.get("pre_tokenizer") or {}
    usual = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not whole.get("normalizer")
    if not usual or [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return plain
    import tiktoken

    # the usual printable stand-ins for bytes: printable Latin-1 as it is, the others from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in vocab.items() if k < 256 + len(merges)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    added = [t["content"] for t in whole.get("added_tokens") or ()] if specials else []

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return plain(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # its engine panics on some very long runs; that type has no importable name
            if type(e).__name__ != "PanicException" and not isinstance(e, (ValueError, RuntimeError)):
                raise
            return plain(text)

    return encode


TOKENS_DDL = "doc_id long, source string, n long, ids binary, pid int, ahead long"


def _tokenize(name: str, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid = encoder(name, specials), TaskContext.get().partitionId()
        sums: dict[str | None, int] = {}
        for batch in batches:
            sources, n, ids, ahead = batch.column("source").to_pylist(), [], [], []
            for source, text in zip(sources, batch.column("text"), strict=True):
                found = encode(text.as_py() or "")
                ids.append(found.astype("<u4").tobytes() + bytes(4) if len(found) and found.max() > 65535 else found.astype("<u2").tobytes() + bytes(2))
                n.append(len(found) + 1)
                ahead.append(sums.get(source, 0))
                sums[source] = ahead[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([pid] * len(n), pa.int32()), pa.array(ahead, pa.int64())],
                names=["doc_id", "source", "n", "ids", "pid", "ahead"],
            )

    return run


class Schedule:
    """Deficit round-robin in closed form.

    totals: tokens of each queue; weights: their target proportions, the queues' own sizes if None. Between two
    exhaustions every queue's credit grows evenly; ``knots`` holds when (in windows) and with how much credit.
    """

    def __init__(self, totals: list[int], window: int, weights: list[float] | None = None):
        self.totals, self.window = totals, window
        shares = [Fraction(w).limit_denominator(10**6) for w in weights] if weights else [Fraction(t) for t in totals]
        left = [Fraction(t) for t in totals]
        at, self.knots = Fraction(0), []
        sent = [Fraction(0)] * len(totals)
        active = [i for i, t in enumerate(totals) if t]
        while active:
            whole = sum(shares[i] for i in active)
            # queues of weight 0 wait until the others are done, then share evenly
            rate = [Fraction(0)] * len(totals)
            for i in active:
                rate[i] = window * shares[i] / whole if whole else Fraction(window, len(active))
            self.knots.append((at, sent[:], rate))
            step = min(left[i] / rate[i] for i in active if rate[i])
            for i in active:
                left[i] -= rate[i] * step
                sent[i] += rate[i] * step
            at += step
            active = [i for i in active if left[i]]
        self.end = at
        self.windows = -(-at.numerator // at.denominator)
        self.times = [k[0] for k in self.knots]
        self.memo: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def given(self, k: int) -> list[int]:
        """Tokens that each queue has given before window k."""
        if k >= self.end:
            return self.totals
        t, sent, rate = self.knots[bisect_right(self.times, k) - 1]
        return [(s + (k - t) * r).__floor__() for s, r in zip(sent, rate, strict=True)]

    def window_at(self, k: int) -> tuple[list[int], list[int], list[int]]:
        """Of window k: each queue's first token, the one after its last, and where its part begins in the stream."""
        if k not in self.memo:
            if len(self.memo) > 4096:
                self.memo.clear()
            a, b = self.given(k), self.given(k + 1)
            place, begins = sum(a), []
            for x, y in zip(a, b, strict=True):
                begins.append(place)
                place += y - x
            self.memo[k] = a, b, begins
        return self.memo[k]

    def find(self, queue: int, token: int, guess: int = 0) -> int:
        """The window that holds a token of a queue."""
        a, b, _ = self.window_at(guess)
        if a[queue] <= token < b[queue]:
            return guess
        low, high = 0, max(1, self.windows)
        while high - low > 1:
            mid = (low + high) // 2
            if self.given(mid)[queue] <= token:
                low = mid
            else:
                high = mid
        return low


PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _cut(queues: object, window: int, length: int, with_ids: bool):
    """queues: broadcast of (source, tokens, weight) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = queues.value
        number = {r[0]: k for k, r in enumerate(rows)}
        plan = Schedule([r[1] for r in rows], window, [r[2] for r in rows] if rows and rows[0][2] is not None else None)
        guess = dict.fromkeys(range(len(rows)), 0)
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for doc, source, n, raw, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "n", "ids", "first")), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                q, done = number[source], 0
                k = plan.find(q, first, guess[q])
                while done < n:
                    a, b, begins = plan.window_at(k)
                    x = first + done
                    if x >= b[q]:
                        k += 1
                        continue
                    place = begins[q] + x - a[q]
                    m = min(n - done, b[q] - x, length - place % length)
                    part = ids[done : done + m]
                    values = (doc, done, m, zlib.crc32(part.tobytes()), n, place // length, place % length, source, part)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    done += m
                guess[q] = k
            kinds = [pa.int64()] * 7 + [pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns[:8], kinds, strict=True)]
            names = PIECES_DDL.replace(",", "").split()[::2]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(p) for p in columns[8]]))).astype(np.int32)
                flat = np.concatenate(columns[8]).astype(np.int32) if columns[8] else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names = [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack(documents: DataFrame, length: int = 1024, window_sequences: int = 32, weights: dict[str | None, float] | tuple[float, ...] | None = None, tokenizer: str = TOKENIZER, with_ids: bool = False, specials: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and ids if asked for).

    ``weights``: target token proportions of the sources, by name, or in turn for sources by code point, null last;
    their own sizes if None, so that every window has the corpus's mixture. A source that runs out leaves its share to the others; nothing is dropped or repeated.
    """
    bounded_batches(documents.sparkSession)
    rows = pick(documents, doc_id="bigint", text="string", source="string")
    tokens = durable(rows.mapInArrow(_tokenize(tokenizer, specials), TOKENS_DDL))
    sums = durable(tokens.groupBy("source", "pid").agg(F.sum("n").alias("n")))
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("b_source"), F.col("pid").alias("b_pid"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    per_source = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.asc_nulls_last("source")).collect()  # a row for each source
    given = [None if weights is None else float(weights.get(r.source, 0.0) if isinstance(weights, dict) else weights[k % len(weights)]) for k, r in enumerate(per_source)]
    queues = [(r.source, r.n, w) for r, w in zip(per_source, given, strict=True)]
    placed = tokens.join(base, (F.col("pid") == F.col("b_pid")) & F.col("source").eqNullSafe(F.col("b_source")))
    placed = placed.select("doc_id", "source", "n", "ids", (F.col("base") + F.col("ahead")).alias("first"))
    shared = documents.sparkSession.sparkContext.broadcast(queues)
    return placed.mapInArrow(_cut(shared, length * window_sequences, length, with_ids), PIECES_DDL + ", ids array<int>" * with_ids)
