"""SimHash near-duplicates against a plain version."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from citeweft.llm import simhash
from test_edges import DDL, ROWS

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    ws = WORD.findall((text or "").encode().lower())
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 4]), 42) for k in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    """The least index that each one reaches over links of four bits or fewer."""
    v = np.array(fps, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    label = np.arange(len(v))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new


def plain(docs):
    """(doc_id, fingerprint, component_id) for all documents; ids are distinct but for None."""
    fps = [plain_fingerprint(t) for _, t in docs]
    label = plain_components(fps)
    least: dict = {}
    for (doc, _), c in zip(docs, label.tolist(), strict=True):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return sorted(((doc, f"{fp:016x}", least.get(c)) for (doc, _), fp, c in zip(docs, fps, label.tolist(), strict=True)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def heap(rng, n, most=6):
    """Fingerprints around a few centres, some of them dense, and random ones."""
    centres = rng.integers(0, 2**63, 4).astype(np.uint64)
    out = [centres, rng.integers(0, 2**63, n // 4).astype(np.uint64)]
    for _ in range(n):
        x = centres[rng.integers(4)]
        for b in rng.integers(0, 64, rng.integers(0, most)):
            x = x ^ (np.uint64(1) << np.uint64(b))
        out.append(np.array([x]))
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("seed", range(8))
def test_tries_find_all_components(seed):
    rng = np.random.default_rng(seed)
    fps = heap(rng, int(rng.integers(1, 500)))
    # every fingerprint in two groups, as in a task that holds several
    a, b, _ = simhash.linked(np.repeat([7, -3], len(fps)), np.concatenate((fps, fps)))
    label = np.arange(len(fps))
    label[np.searchsorted(fps, b)] = np.searchsorted(fps, a)
    assert (label == plain_components(fps)).all()


def test_dense_heaps_are_not_compared_pair_by_pair():
    """Near copies that fill the ball around one text: pairs of nodes grow as the fingerprints, not as their square."""
    rng = np.random.default_rng(9)
    taken = []
    for n in (4000, 16000):
        flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 4), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in range(n)]
        fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ np.array(flips, np.uint64))
        a, _, seen = simhash.linked(np.zeros(len(fps), np.int64), fps)
        assert len(a) == len(fps) - 1
        taken.append((len(fps), seen))
    (n, x), (m, y) = taken
    assert y / x < 1.5 * m / n


def test_every_choice_of_blocks_keeps_links():
    for n in (1, 1 << 26, 1 << 36, 1 << 60):
        masks = simhash.choices(n)
        rng = np.random.default_rng(n % 97)
        for _ in range(300):
            apart = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not apart & m for m in masks)
    assert len(simhash.choices(1)) == 5 and len(simhash.choices(1 << 60)) == 70


@pytest.mark.parametrize("few", [0, 100_000])
def test_large_groups_go_in_tiles(spark, monkeypatch, few):
    """With tiles of ten fingerprints, the links are those of the whole table."""
    monkeypatch.setattr(simhash, "FEW", few)
    fps = heap(np.random.default_rng(11), 300, most=4)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    pairs = simhash.links(df, most=10).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        for r in pairs:
            label[at[r.a]] = label[at[r.b]] = min(label[at[r.a]], label[at[r.b]])
        if (label == before).all():
            break
    assert (label == plain_components(fps)).all()


def test_near_duplicates(spark):
    """Exact and near copies, long texts, unrelated ones."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(500)]
    base = [list(rng.choice(words, 300)) for _ in range(30)]
    docs = []
    for k in range(240):
        ws = list(base[k % 30])
        for _ in range(int(rng.integers(0, 3))):
            ws[int(rng.integers(300))] = "changed"
        docs.append((k * 3 - 50, " ".join(ws).title() if k % 7 == 0 else "\n".join(ws)))
    want = plain(docs)
    assert len({c for _, _, c in want}) < 200
    assert got(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == want


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"w{k % 97} é{k % 13}" for k in range(3000))
    whole = simhash.fingerprint(text.encode())
    assert whole == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "LARGE", 10)
    for size in (1, 2, 3, 7, 6000):
        monkeypatch.setattr(simhash, "WORDS", size)
        if size >= simhash.SHINGLE:
            assert simhash.fingerprint(text.encode()) == whole
    monkeypatch.setattr(simhash, "WORDS", 4)
    for n in (1, 3, 4, 5, 8, 9):
        some = " ".join(f"longish-word-{k}" for k in range(n))
        assert simhash.fingerprint(some.encode()) == plain_fingerprint(some)


def test_edges(spark):
    """Nulls and empty texts share the fingerprint zero and link; one id in several rows ties its texts."""
    df = spark.createDataFrame(ROWS, DDL)
    wide = df.select("*", df.text.alias("TEXT"), df.doc_id.alias("fp"), df.lang.alias("key"), df.lang.alias("key"))
    rows = got(simhash.near_duplicates(wide))
    assert rows == plain([(r[0], r[1]) for r in ROWS])
    said = {d: (f, c) for d, f, c in rows}
    assert said[0] == said[1] == said[2] == ("0" * 16, 0)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    tied = [(4, "one text of its own"), (4, "another text altogether"), (9, "another text altogether"), (None, "nobody knows me"), (None, "one text of its own")]
    rows = got(simhash.near_duplicates(spark.createDataFrame(tied, "doc_id long, text string")))
    assert {(d, c) for d, _, c in rows} == {(4, 4), (9, 4), (None, None), (None, 4)}
    assert len(rows) == 5


def test_a_third_of_the_rows_are_copies(spark):
    docs = [(k, "the same words in all of these" if k % 3 == 0 else f"text {k} stands {k * k} alone {k + 7} here") for k in range(600)]
    assert got(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)
