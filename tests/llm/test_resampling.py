"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from citeweft.llm import resampling
from hypothesis import given, settings
from hypothesis import strategies as st
from test_edges import DDL, ROWS

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_runs(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    ws = WORD.findall(lower)
    return len(ws), [" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def plain_bucket(run):
    return zlib.crc32(run.encode()) % 10000


def plain(docs, target, percent=5, least=20):
    """(doc_id, n_features, weight, score) -> rank for all documents."""
    s = Counter(plain_bucket(r) for _, text in docs for r in plain_runs(text)[1])
    t = Counter(plain_bucket(r) for text in target for r in plain_runs(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    rows = []
    for doc, text in docs:
        n, runs = plain_runs(text)
        weight = sum(gain(plain_bucket(r)) for r in runs)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@given(st.lists(st.one_of(st.none(), st.text("aZ9 .é　ß-\n", max_size=40)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_automaton_finds_all_runs(texts):
    """Words by the byte classes and CRCs that go on over a blank, text by text, in slices of an Arrow column too."""
    column = pa.array(["pad me", *texts, "z"], pa.string()).slice(1, len(texts))
    found = [Counter() for _ in texts]
    for of, bucket in resampling.buckets(column):
        for k, b in zip(of.tolist(), bucket.tolist(), strict=True):
            found[k][b] += 1
    assert found == [Counter(plain_bucket(r) for r in plain_runs(t)[1]) for t in texts]
    assert resampling.words_of(column)[3].tolist() == [plain_runs(t)[0] for t in texts]


def test_words_of_any_length(monkeypatch):
    """Words below, at and beyond the length that advances step by step, over the borders of chunks."""
    monkeypatch.setattr(resampling, "CHUNK", 5)
    rng = np.random.default_rng(3)
    texts = [" ".join("x" * int(n) for n in rng.integers(1, 70, 23)), "y" * 300 + " a " + "é" * 40_000, "", "b"]
    found = [Counter() for _ in texts]
    for of, bucket in resampling.buckets(pa.array(texts)):
        for k, b in zip(of.tolist(), bucket.tolist(), strict=True):
            found[k][b] += 1
    assert found == [Counter(plain_bucket(r) for r in plain_runs(t)[1]) for t in texts]


def test_edges(spark):
    """Nulls, empty and long texts, repeats, clashing columns, empty tables."""
    df = spark.createDataFrame(ROWS, DDL)
    wide = df.select("*", df.text.alias("TEXT"), df.doc_id.alias("score"), df.doc_id.alias("rank"), df.lang.alias("part"), df.lang.alias("part"))
    target = ["word token w1 w2", None, ""]
    of = spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    assert got(resampling.resample(wide, of, percent=50)) == plain([(r[0], r[1]) for r in ROWS], target, percent=50)
    assert resampling.resample(df.limit(0), of).count() == 0
    none = got(resampling.resample(df, of.limit(0)))
    assert none == plain([(r[0], r[1]) for r in ROWS], [])


@pytest.mark.parametrize("partitions", [1, 9])
def test_ranks_hold_over_ranges(spark, partitions):
    """A third of the rows are copies of one text, some with one id; ranks are gapless whatever the partitions."""
    rng = np.random.default_rng(4)
    copy = " ".join(f"c{k}" for k in range(25))
    docs = [(int(k), copy if k % 3 == 0 else " ".join(rng.choice(["a", "b", "c", "d"], 19 + int(k) % 4))) for k in range(900)]
    docs += [(5, copy)] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    of = spark.createDataFrame([("a b c",), ("c1 c2 c3",)], "text string")
    rows = got(resampling.resample(df, of))
    assert rows == plain(docs, ["a b c", "c1 c2 c3"])
    drawn = sorted(r[4] for r in rows if r[4] is not None)
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 30
