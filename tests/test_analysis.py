"""Estimates, stopping rules, simulation, ranking and statistics, on cases worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import plain
import pytest
from citeweft.model import Arm, Eligibility
from citeweft.operators import eligibility, estimate, expand, loglinear, rank, simulate, stats, stopping
from pyspark.sql import functions as F

H = "trial string, n int, n_screened long, n_included long, cumulative_screened long, cumulative_included long, frontier_size long, yield_rate double"


def hist(spark, curve):
    rows, s, i = [], 0, 1
    for n, (a, b) in enumerate(curve, 1):
        s, i = s + a, i + b
        rows.append(("t", n, a, b, s, i, b, b / a if a else 0.0))
    return spark.createDataFrame(rows, H)


def captures(spark, cells):
    rows, k = [], 0
    for pattern, n in cells.items():
        for _ in range(n):
            rows.append((f"k{k}", *(c == "1" for c in pattern)))
            k += 1
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"{x} boolean" for x in "abc"[: len(pattern)]))


@pytest.mark.parametrize(("n1", "n2", "m", "seen", "reason"), [(60, 50, 30, 80, None), (10, 10, 2, 18, "overlap_below_minimum"), (0, 10, 0, 10, "overlap_below_minimum"), (337, 83, 83, 337, "nested_arms"), (153, 79, 71, 161, None)])
def test_chapman(spark, n1, n2, m, seen, reason):
    r = estimate.chapman(spark.createDataFrame([(n1, n2, m, seen)], "n1 long, n2 long, m long, n_observed long")).collect()[0]
    assert r.reason == reason
    if reason is None:
        assert abs(r.n_hat - ((n1 + 1) * (n2 + 1) / (m + 1) - 1)) < 1e-9 and seen <= r.n_hat_low <= r.n_hat_high and r.recall_low <= r.recall <= r.recall_high


@pytest.mark.parametrize(("s", "f1", "f2", "reason"), [(478, 478, 0, "all_singletons"), (100, 70, 30, None), (50, 45, 0, None), (10, 0, 10, None), (0, 0, 0, "no_records")])
def test_chao(spark, s, f1, f2, reason):
    r = estimate.chao1(spark.createDataFrame([(s, f1, f2)], "s_obs long, f1 long, f2 long")).collect()[0]
    assert r.reason == reason and (reason is not None or r.n_hat_low <= r.n_hat <= r.n_hat_high)
    if (s, f1, f2) == (10, 0, 10):
        assert r.recall == 1.0 and r.n_hat_low == r.n_hat_high == 10
    if (s, f1, f2) == (100, 70, 30):
        assert abs(r.n_hat - (100 + 4900 / 60)) < 1e-9


@pytest.mark.parametrize(
    ("cells", "reason"),
    [
        ({"100": 70, "110": 60, "101": 18, "111": 5, "010": 8, "001": 3, "011": 0}, "empty_pair_cell"),
        ({"100": 82, "110": 71, "010": 8, "001": 0, "101": 0, "011": 0, "111": 0}, "empty_arm"),
        ({"100": 40, "010": 30, "001": 25, "110": 20, "101": 18, "011": 15, "111": 12}, None),
        ({p: 0 for p in ("100", "010", "001", "110", "101", "011", "111")}, "no_records"),
    ],
)
def test_loglinear(spark, cells, reason):
    assert fitted(spark, [cells])[0].reason == reason == plain.loglinear(cells)["reason"]


def fitted(spark, tables):
    """What the operator says of tables of counts by pattern, all at once."""
    k = len(next(iter(tables[0])))
    rows = [(t, p, n) for t, counts in enumerate(tables) for p, n in counts.items()]
    cells = spark.createDataFrame(rows, "t int, pattern string, n long")
    return sorted(loglinear.select(loglinear.table_of(cells, k, ("t",)), k).collect(), key=lambda r: r.t)


@pytest.mark.parametrize("k", [3, 4])
def test_loglinear_fits_are_those_of_least_squares(spark, k):
    """Many tables in one pass against a solver of one at a time."""
    rng = np.random.default_rng(k)
    tables = [{format(p, f"0{k}b"): int(n) for p, n in enumerate(rng.poisson(np.exp(rng.normal(3.5, 0.6, (1 << k) - 1))) + 1, 1)} for _ in range(12 if k == 3 else 2)]
    for got, counts in zip(fitted(spark, tables), tables, strict=True):
        want = plain.loglinear(counts)
        assert (got.n_observed, got.reason, got.terms) == (want["n_observed"], want["reason"], ",".join(want["terms"]))
        assert math.isclose(got.aic, want["aic"], rel_tol=1e-8)
        if got.estimable:
            assert math.isclose(got.n_hat, want["n_hat"], rel_tol=1e-6) and math.isclose(got.recall, want["recall"], rel_tol=1e-6)


def test_loglinear_of_odd_tables(spark):
    """Missing and null patterns count 0; two arms have the one model; no tables give no rows."""
    cells = spark.createDataFrame([(0, "10", 30), (0, "01", 20), (0, "11", None), (1, "10", 30), (1, "01", 20), (1, "11", 10)], "t int, pattern string, n long")
    a, b = sorted(loglinear.select(loglinear.table_of(cells, 2, ("t",)), 2).collect(), key=lambda r: r.t)
    assert a.reason == "implausible" and b.estimable and math.isclose(b.n_hat, 120)
    assert loglinear.select(loglinear.table_of(cells.limit(0), 2, ("t",)), 2).count() == 0


def test_loglinear_of_independent_arms(spark):
    p, n = (0.5, 0.4, 0.3), 10000
    cells = {}
    for k in range(1, 8):
        bits = f"{k:03b}"
        cells[bits] = round(n * math.prod(q if b == "1" else 1 - q for q, b in zip(p, bits, strict=True)))
    out = fitted(spark, [cells])[0]
    assert out.estimable and abs(out.n_hat - n) < 60


def test_cells_and_overlap(spark):
    h = captures(spark, {"10": 5, "11": 3, "01": 2})
    assert {r.pattern: r.n for r in estimate.cells(h, ["a", "b"]).collect()} == {"10": 5, "11": 3, "01": 2}
    r = estimate.overlap(h, ["a", "b"]).collect()[0]
    assert (r.n1, r.n2, r.m, r.n_observed) == (8, 5, 3, 10)
    assert estimate.estimate_recall(h, ["a"])["reason"] == "fewer_than_two_arms"


def test_dependent_arms_are_told(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(3000):
        easy = rng.random() < 0.5
        c = [bool(x) for x in rng.random(3) < (0.8 if easy else 0.2)]
        if any(c):
            rows.append((f"k{k}", *c))
    said = estimate.dependence(estimate.odds(spark.createDataFrame(rows, "key string, a boolean, b boolean, c boolean"), ["a", "b", "c"]))
    assert said and all("positively" in s for s in said)


def test_unknown_membership_set():
    with pytest.raises(KeyError):
        estimate.arm_predicate(Arm("x", member_of="nope"))


def fired(df):
    return [r.triggered for r in df.orderBy("n").collect()]


def test_marginal_yield(spark):
    assert fired(stopping.marginal_yield(hist(spark, [(500, 40)]))) == [False]
    assert fired(stopping.marginal_yield(hist(spark, [(500, 40), (200, 10)]))) == [False, False]
    assert fired(stopping.marginal_yield(hist(spark, [(500, 40), (200, 1), (200, 0)]))) == [False, False, True]


def test_asymptote(spark):
    rows = stopping.asymptotic_coverage(hist(spark, [(500, 40), (300, 12), (200, 3), (150, 1), (120, 0)])).orderBy("n").collect()
    assert not rows[2].triggered and rows[-1].value >= 0.95 and rows[-1].triggered
    x = list(range(1, 9))
    n, rate = stopping.fit_asymptote(x, [100 * (1 - math.exp(-0.6 * k)) for k in x])
    assert abs(n - 100) < 1e-3 and abs(rate - 0.6) < 1e-4


def test_recall_rule_is_advisory(spark):
    trail = spark.createDataFrame([("t", k, True, n, 0.96, 0.95) for k, n in enumerate([99.5, 100.0, 100.0], 1)], "trial string, n int, estimable boolean, n_hat double, recall double, recall_low double")
    rule = stopping.recall_stability(trail, tau=0.9)
    assert fired(rule) == [False, False, True]
    none = stopping.exhaustion(hist(spark, [(5, 1)] * 3))
    assert not any(r.stop for r in stopping.rule_set(rule.union(none), ["estimated_recall"]).collect())
    loud = stopping.recall_stability(trail, tau=0.9, authoritative=True)
    assert [r.stopped_by for r in stopping.rule_set(loud.union(none), ["estimated_recall"]).orderBy("n").collect()] == [None, None, "estimated_recall"]


def test_all_of(spark):
    h = hist(spark, [(10, 5), (10, 0)])
    d = stopping.marginal_yield(h, 0.9, 1).union(stopping.budget(h, 15)).union(stopping.exhaustion(h.withColumn("frontier_size", F.lit(3))))
    assert [r.stop for r in stopping.rule_set(d, ["budget"], "all_of").orderBy("n").collect()] == [False, True]


def test_curves(spark):
    h = hist(spark, [(100, 4), (100, 3), (100, 2)])
    c = simulate.recall_curve(h, 10)
    assert [r.recall for r in c.orderBy("n").collect()] == [0.5, 0.8, 1.0]
    assert simulate.burden(c, [0.8, 0.95]).orderBy("target").collect()[0].screened == 200
    f = spark.createDataFrame([("t", "early", 1), ("t", "late", 3), ("t", "never", None)], "trial string, rule string, fired_at int")
    got = {r.rule: r for r in simulate.outcomes(c, f, 10, 0.8).collect()}
    assert (got["early"].missed, got["early"].overshoot, got["late"].excess, got["never"].regret) == (3, -1, 100, None)
    assert abs(got["early"].regret - 0.3) < 1e-9 and abs(got["late"].regret - 0.5) < 1e-9


def test_calibration(spark):
    df = spark.createDataFrame([(0.95, 0.80), (0.92, 0.85), (0.99, 0.90)], "estimated double, true double")
    r = simulate.calibration(df).collect()[0]
    assert abs(r.bias - 0.31 / 3) < 1e-9 and r.overestimate_rate == 1.0 and r.n == 3


def test_crawl_of_all_trials_at_once(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "c"), ("c", "s"), ("x", "y")], "src string, dst string").withColumn("direction", F.lit("backward")).withColumn("provider", F.lit("p"))
    gold = spark.createDataFrame([("s",), ("a",), ("c",), ("x",)], "key string")
    seeds = spark.createDataFrame([("1", "s"), ("2", "x")], "trial string, key string")
    got = sorted(tuple(r) for r in expand.snowball(edges, seeds, gold).collect())
    assert got == [("1", "a", 1, True), ("1", "b", 1, False), ("1", "c", 2, True), ("1", "s", 0, True), ("2", "x", 0, True), ("2", "y", 1, False)]
    rows = expand.history(expand.snowball(edges, seeds, gold)).where("trial = '1'").orderBy("n").collect()
    assert [(r.n_screened, r.cumulative_included, r.frontier_size) for r in rows] == [(2, 2, 1), (1, 3, 1)]


def test_synthetic_graph_has_no_cycle(spark):
    works, edges, gold = simulate.synthetic_graph(spark, 40, 200)
    assert works.count() == 240 and edges.where("src <= dst").count() == 0 and gold.count() > 20


def test_eligibility_reasons(spark):
    df = spark.createDataFrame([("t", None, False, 2000, "a", "en"), (" ", None, False, 2000, "a", "en"), ("t", None, True, None, None, None), ("t", None, None, 1990, "b", "de"), ("t", None, None, None, None, None), ("t", None, None, 2020, "b", "de")], "title string, abstract string, is_retracted boolean, year int, type string, language string")
    e = Eligibility(year_min=1995, year_max=2015, types=("a",), languages=("en",))
    assert [r[0] for r in df.select(eligibility.reason(e)).collect()] == [None, "no_title", "retracted", "year_below_min", None, "year_above_max"]
    strict = Eligibility(year_min=1995, types=("a",), keep_unknown=False)
    assert [r[0] for r in df.select(eligibility.reason(strict)).collect()][4:] == ["no_year", "type_not_allowed"]


def test_ranks_do_not_hang_on_partitions(spark):
    scores = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "key string, score double")
    for parts in (1, 4, 13):
        assert [(r.key, r["rank"]) for r in rank.positions(scores.repartition(parts)).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert [r.key for r in rank.top(scores, 2).orderBy("rank").collect()] == ["a", "b"]


def test_bm25_prefers_shared_terms(spark):
    inc = spark.createDataFrame([("i", ["citation", "search"])], "key string, terms array<string>")
    cand = spark.createDataFrame([("x", ["citation", "search", "methods"]), ("y", ["botany", "leaf"]), ("z", [])], "key string, terms array<string>")
    got = {r.key: r.score for r in rank.bm25(inc, cand).collect()}
    assert got["x"] > 0 and got["y"] == got["z"] == 0
    assert {r.score for r in rank.bm25(inc.limit(0), cand).collect()} == {0.0}


def test_network_features(spark):
    prov = spark.createDataFrame([("s", "p1", "backward"), ("s", "p2", "forward"), ("w", "p1", "backward"), ("i", "p1", "backward"), ("i", "p2", "backward")], "key string, parent string, direction string")
    inc = spark.createDataFrame([("p1",), ("p2",), ("i",)], "key string")
    cand = spark.createDataFrame([("s",), ("w",)], "key string")
    f = rank.network_features(prov, cand, inc)
    assert {r.key: (r.n_parents, r.cocitation, r.both_directions) for r in f.collect()} == {"s": (2, 2, 1), "w": (1, 1, 0)}
    s = {r.key: r.score for r in rank.network_score(f).collect()}
    assert s["s"] == pytest.approx(1.0) and s["w"] == 0.0


def test_fusion(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "key string, score double")
    b = spark.createDataFrame([("y", 5.0)], "key string, score double")
    got = {r.key: r.score for r in rank.fuse({"a": a, "b": b}).collect()}
    assert got["x"] == pytest.approx(1 / 61 + 1 / 62) and got["y"] == pytest.approx(1 / 62 + 1 / 61)
    with pytest.raises(ValueError):
        rank.build("nope")


def test_statistics(spark):
    scores = spark.createDataFrame([(f"k{i}", r, float(s)) for i, row in enumerate([(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]) for r, s in zip("abcd", row, strict=True)], "key string, rater string, score double")
    assert stats.icc21(scores).collect()[0].icc == pytest.approx(0.2897638, abs=1e-6)
    pairs = spark.createDataFrame([(True, True)] * 20 + [(True, False)] * 5 + [(False, True)] * 10 + [(False, False)] * 15, "a boolean, b boolean")
    r = stats.agreement(pairs).collect()[0]
    assert r.kappa == pytest.approx(0.4) and r.pabak == pytest.approx(0.4)
    a = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "score double, positive boolean")
    assert stats.auc(a).collect()[0].auc == pytest.approx(3.5 / 4)
    t = spark.createDataFrame([(s,) for s in ['x [{"id":"a","score":7},{"id":"b","score":12}] y', "nothing"]], "reply string")
    assert [tuple(r) for r in stats.parse_scores(t).collect()] == [("a", 7.0)]
    ci = stats.bootstrap_mean(scores.where("rater = 'a'").select("key", F.col("score").alias("value"))).collect()[0]
    assert ci.low < ci.mean < ci.high


def test_texts_are_taken_apart_once(spark):
    """TF-IDF and BM25 read the terms of a text once, or once and for its length, whatever is made of them after."""
    from citeweft.operators import stats

    seen = spark.sparkContext.accumulator(0)

    def split(text):
        seen.add(1)
        return text.split()

    texts = [(k, f"graph search w{k % 3} only{k}") for k in range(12)]
    # one part, so that a read of the texts is a call for each
    docs = spark.createDataFrame(texts, "key long, text string").coalesce(1).select("key", F.udf(split, "array<string>")("text").alias("terms"))
    core = spark.createDataFrame([(0,), (1,), (2,)], "key long")
    got = {r.key: r.similarity for r in stats.topic_similarity(stats.tfidf(docs), core).collect()}
    assert len(got) == 12 and got[0] > got[3] > 0
    assert seen.value <= 24
    assert len(rank.bm25(docs.where("key < 3"), docs.where("key >= 3")).collect()) == 9
    assert seen.value <= 24 + 3 * 12
