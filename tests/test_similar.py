"""The index of letters against all pairs; the bounds against the similarity itself."""

from __future__ import annotations

import random

import numpy as np
import pytest
from citeweft.functions.udfs import jaro_winkler
from citeweft.operators import similar
from citeweft.sources import landed
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def slow_jaro_winkler(a, b):
    """Letter by letter, as it is defined."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, x in zip(b, used, strict=True) if x]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) // 2) / m) / 3
    head = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 4)
    return jaro if jaro <= 0.7 else jaro + 0.1 * head * (1 - jaro)


@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
@settings(max_examples=500, deadline=None)
def test_similarity_in_one_pass(a, b):
    assert jaro_winkler(a, b) == slow_jaro_winkler(a, b)


def titles(rng, n):
    """Titles of all lengths, some with letters changed, moved, dropped or added."""
    words = ["citation", "graph", "search", "review", "of", "a", "for", "learning", "zebra", "x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    out = list(base)
    for t in base:
        for _ in range(2):
            s = list(t)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(s)) if s else 0
                s[k : k + 1] = rng.choice([[], ["q"], s[k : k + 1] * 2, []])
            if len(s) > 5 and rng.random() < 0.4:
                k = rng.randrange(len(s) - 2)
                s[k], s[k + 1] = s[k + 1], s[k]
            out.append("".join(s))
    return out + ["", "a", "ab", "abc", "abcd", "é", "été", "ete"]


@pytest.mark.parametrize("least", [0.85, 0.95])
def test_no_pair_is_lost(spark, least):
    own = sorted(set(titles(random.Random(7), 60)) - {""})
    df = spark.createDataFrame([(t,) for t in [*own, own[3], None, ""]], "t string")
    got = sorted((r.a, r.b, round(r.score, 9)) for r in similar.similar(df, None, least).collect())
    want = sorted((a, b, round(s, 9)) for a in own for b in own if a < b and (s := slow_jaro_winkler(a, b)) >= least)
    assert got == want and len(want) > 40
    other = own[::3]
    two = similar.similar(df, spark.createDataFrame([(t,) for t in other], "t string"), least).collect()
    assert sorted((r.a, r.b) for r in two) == sorted((a, b) for a in own for b in other if slow_jaro_winkler(a, b) >= least)


def test_edges(spark):
    none = spark.createDataFrame([], "t string")
    some = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    assert similar.similar(none, None, 0.9).count() == similar.similar(some, none, 0.9).count() == similar.similar(none, some, 0.9).count() == 0
    assert [(r.a, r.b, r.score) for r in similar.similar(some, some, 0.9).collect()] == [("a b c", "a b c", 1.0)]
    with pytest.raises(ValueError, match="threshold"):
        similar.similar(some, None, 0.7)


@given(st.text("ab c", min_size=1, max_size=10), st.text("ab c", min_size=1, max_size=10), st.sampled_from([0.82, 0.9, 0.95]))
@settings(max_examples=300, deadline=None)
def test_bound_on_letters_is_sound(a, b, least):
    """The bound, worked out in plain Python, never rules out a pair that reaches the threshold."""
    if slow_jaro_winkler(a, b) >= least:
        head = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 4)
        need = (3 * similar.least_jaro(least, head) - 1) * len(a) * len(b) / (len(a) + len(b)) - 1e-6
        assert min(len(a), len(b)) >= need and sum(min(a.count(c), b.count(c)) for c in set(a)) >= need


def test_possible_pairs(spark):
    rng = random.Random(8)
    own = [t for t in titles(rng, 12) if t]
    pairs = [(a, b) for a in own for b in own]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similar.possible(F.col("a"), F.col("b"), 0.9).alias("p"))
    rows = df.collect()
    assert all(r.p for r in rows if slow_jaro_winkler(r.a, r.b) >= 0.9) and sum(r.p for r in rows) < len(rows) / 2


def test_references_are_matched_from_works_alone(spark):
    """No candidates are given: the index makes them, and the matcher takes the best whose year fits."""
    works = [(1, "graph search for reviews", "Graph search for reviews", "10.1000/a", 2001), (2, "graph search for review", "Graph search for review", "10.1000/b", 1990), (3, "something else altogether", "Something else altogether", "10.1000/c", 2001)]
    w = spark.createDataFrame(works, "key int, title_norm string, title string, doi string, year int")
    refs = spark.createDataFrame([("p", 0, "Graph search for revews", 2000, None), ("p", 1, "nothing like it", 2000, None), ("p", 2, "Something Else Altogether", None, "10.9/own")], "path string, ord int, title string, year int, doi string")
    r = landed.with_own_candidates(refs, w).collect()
    assert {(x.ord, x.doi) for x in r} == {(0, "10.1000/a"), (1, None), (2, "10.9/own")}


def test_many_pairs_at_once_are_scored_as_one_by_one(spark):
    """The vectorised similarity is the plain one to the last bit; long titles of one language take part in chunks of few letters."""
    from citeweft.functions.jaro import Letters

    rng = random.Random(11)
    texts = sorted({"".join(rng.choice("abc dé𝄞") for _ in range(rng.randint(1, 30))) for _ in range(120)})
    texts += [" ".join(rng.choice(("die", "und", "schen", "ver", "heit")) for _ in range(200)) for _ in range(6)]
    known = Letters(texts)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    assert known.similarity(a, b).tolist() == [jaro_winkler(texts[i], texts[j]) for i, j in zip(a, b, strict=True)]
    for i in range(len(texts)):
        near = set(known.possible(i, np.arange(len(texts)), 0.85).tolist())
        assert all(j in near for j in range(len(texts)) if jaro_winkler(texts[i], texts[j]) >= 0.85)


def test_pairs_are_made_inside_tiles(spark, monkeypatch):
    """No pair goes through a shuffle before it is compared, and chunks beyond their size are cut: every pair is found still."""
    monkeypatch.setattr(similar, "SIDES", (8, 8))
    own = sorted(set(titles(random.Random(9), 40)) - {""})
    df = spark.createDataFrame([(t,) for t in own], "t string")
    got = similar.similar(df, None, 0.9)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString().split("FlatMapGroups")[0]
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((a, b) for a in own for b in own if a < b and jaro_winkler(a, b) >= 0.9)


def test_order_of_heads_rules_pairs_out_and_loses_none():
    """Texts of the same letters in another order go by their heads; no pair that reaches the threshold does."""
    from citeweft.functions.jaro import Letters, Others

    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("abcdefgh "[:k]), n)) for k in (2, 3, 9) for n in (1, 2, 5, 30, 200) for _ in range(6)]
    for t in list(texts):  # some swaps, some letters gone
        u = rng.permutation(list(t)) if len(t) < 6 else list(t[:-3]) + list(rng.permutation(list(t[-3:])))
        texts += ["".join(u), t[: len(t) // 2] + t[len(t) // 2 + 1 :] or "a"]
    known = Letters(texts)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    score = known.similarity(i, j)
    for least in (0.8, 0.9, 0.97):
        assert known.ordered(i, j, least)[score >= least].all()
    one = list("abcdefghijklmnopqrstuvwxyz" * 8)
    known = Letters(["".join(rng.permutation(one)) for _ in range(30)])
    held = Others(known, np.arange(30), 0.9)
    assert all(len(held.possible(k, 0, 30)) == 30 for k in range(30))  # their letters allow every pair
    i, j = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    assert (known.ordered(i, j, 0.9) == (i == j)).all()


def test_reached_is_the_similarity_or_null(spark):
    """Nulls, empty texts and what stays below the threshold are null, as NaN would pass every condition."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.choice([1, 4, 30, 90]))) for _ in range(40)]
    pairs = [(a, b[:k] + b[k + 1 :]) for a in texts for b in (a, rng.choice(texts)) for k in (0, len(b) // 2)] + [(None, "a"), ("a", None), ("", ""), ("a", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similar.lengths_allow(F.col("a"), F.col("b"), 0.9).alias("may"), similar.reached(F.col("a"), F.col("b"), 0.9).alias("s")).collect()
    for r in rows:
        score = jaro_winkler(r.a, r.b) if r.a and r.b else 0.0
        assert r.s == (score if score >= 0.9 else None)
        assert r.may or r.s is None
    assert any(r.s for r in rows) and not all(r.s for r in rows)
