"""Studies against plain recounts and cases worked out by hand."""

from __future__ import annotations

import math
import re

import plain as plain_versions
from citeweft import storage
from citeweft.operators import estimate, simulate, stats, stopping, studies
from pyspark.sql import functions as F

CURVE = "trial string, n int, cumulative_screened long, cumulative_included long, recall double"


def crawl(spark):
    found = [("t", "s", 0, True), ("t", "a", 1, True), ("t", "b", 1, True), ("t", "x", 1, False), ("t", "c", 2, True), ("u", "s", 0, True)]
    edges = [("s", "a", "A"), ("s", "b", "R"), ("a", "b", "A"), ("b", "c", "A"), ("a", "c", "R"), ("s", "x", "A"), ("c", "a", "R")]
    return spark.createDataFrame(found, "trial string, key string, n int, included boolean"), spark.createDataFrame(edges, "src string, dst string, provider string")


def test_histories_by_round_equal_a_recount(spark):
    found, edges = crawl(spark)
    arms = {"a": F.col("provider") == "A", "r": F.col("provider") == "R"}
    rounds = spark.createDataFrame([("t", n) for n in (1, 2, 3)] + [("u", 1)], "trial string, n int")
    got = {(x.trial, x.n): (x.n1, x.n2, x.m, x.s_obs, x.f1, x.f2) for x in studies.capture_counts(studies.by_round(studies.first_captures(found, edges, arms), rounds, ["a", "r"]), ["a", "r"]).collect()}
    born = {"s": 0, "a": 1, "b": 1, "c": 2}
    for n in (1, 2, 3):
        sets = {p: {d for s, d, q in edges.collect() if q == p and s in born and d in born and max(born[d], born[s] + 1) <= n} for p in "AR"}
        a, r = sets["A"], sets["R"]
        assert got["t", n] == (len(a), len(r), len(a & r), len(a | r), len(a ^ r), len(a & r))
    assert ("u", 1) not in got


def test_no_captures_and_no_rows(spark):
    found, edges = crawl(spark)
    arms = {"a": F.col("provider") == "A", "r": F.col("provider") == "R"}
    firsts = studies.first_captures(found, edges.limit(0), arms)
    assert firsts.count() == 0
    curve = spark.createDataFrame([("t", 1, 3, 2, 0.5)], CURVE)
    counts = studies.capture_counts(studies.by_round(firsts, curve, ["a", "r"]), ["a", "r"])
    one = studies.overlap_reviews(counts, curve).collect()[0]
    assert (one.trial, one.mean_overlap, one.fired_at, one.reachable) == ("t", 0.0, None, 0.5)
    empty = studies.benchmark_summary(spark.createDataFrame([], "final_recall double, estimated_recall double")).collect()[0]
    assert (empty.n_trials, empty.mean_final_recall, empty.n_estimated) == (0, 0.0, 0)


def test_trials_end_at_their_stop(spark):
    curve = spark.createDataFrame([("t", 1, 10, 4, 0.4), ("t", 2, 30, 8, 0.8), ("t", 3, 90, 9, 0.9), ("u", 1, 5, 1, 0.1)], CURVE)
    decided = spark.createDataFrame([("t", 1, False, None), ("t", 2, True, "budget"), ("t", 3, True, "exhaustion")], "trial string, n int, stop boolean, stopped_by string")
    estimates = spark.createDataFrame([("t", 2, 0.7), ("t", 3, 0.99)], "trial string, n int, recall double")
    results = studies.trial_results(studies.until_stop(curve, decided), estimates)
    rows = {r.trial: r for r in results.collect()}
    t, u = rows["t"], rows["u"]
    assert (t.n_found, t.final_recall, t.iterations, t.total_screened, t.stopped_by, t.burden_80, t.burden_90, t.estimated_recall) == (8, 0.8, 2, 30, "budget", 30, None, 0.7)
    assert (u.iterations, u.stopped_by, u.estimated_recall) == (1, None, None)
    s = studies.benchmark_summary(results).collect()[0]
    assert (s.n_trials, s.n_estimated) == (2, 1) and math.isclose(s.mean_final_recall, 0.45) and math.isclose(s.bias, -0.1)


def test_asymptote_grid_equals_a_search_of_all_points(spark):
    ys = [40, 61, 72, 78, 81, 82]
    rows = [("t", n, y) for n, y in enumerate(ys, 1)]
    got = {r.n: r for r in studies.asymptote_grid(spark.createDataFrame(rows, "trial string, n int, cumulative_included long")).collect()}
    for cut in range(1, 7):
        if cut < 4:
            assert got[cut].value is None and not got[cut].triggered
            continue
        error = lambda top, rate: sum((top * (1 - math.exp(-rate * x)) - y) ** 2 for x, y in enumerate(ys[:cut], 1))  # noqa: B023, E731
        best = min((error(ys[cut - 1] * (1 + j / 40), 0.05 * r), j) for j in range(81) for r in range(1, 61))
        assert math.isclose(got[cut].value, 1 / (1 + best[1] / 40)) and got[cut].triggered == (got[cut].value >= 0.95)


def test_curve_outcomes(spark):
    curve = spark.createDataFrame([("t", 1, 10, 4, 0.4), ("t", 2, 30, 8, 0.8), ("t", 3, 90, 9, 0.9)], CURVE)
    fired = spark.createDataFrame([("t", "late", 3), ("t", "early", 1), ("t", "never", None)], "trial string, rule string, fired_at int")
    rows = {r.rule: r for r in studies.curve_outcomes(curve, fired, 0.8).collect()}
    assert (rows["late"].overshoot, rows["late"].excess, rows["late"].missed, rows["late"].regret) == (1, 60, 0, 0.0)
    assert (rows["early"].overshoot, rows["early"].missed) == (-1, 5) and math.isclose(rows["early"].regret, 0.5)
    assert rows["never"].optimal_n == 2 and rows["never"].regret is None
    assert {r.optimal_n for r in studies.curve_outcomes(curve, fired, 0.95).collect()} == {None}


def test_coverage_against_the_estimators_one_by_one(spark):
    cells = [("t", 2, True, True, False, 20), ("t", 2, True, False, False, 15), ("t", 2, False, True, True, 9), ("t", 2, False, False, True, 7)]
    h = spark.createDataFrame(cells, "trial string, n int, a boolean, b boolean, c boolean, works long")
    history = spark.createDataFrame([("t", 2, 60)], "trial string, n int, cumulative_included long")
    rows = studies.coverage_rows(studies.capture_counts(h, list("abc")), history)
    by = {r.estimator: r for r in rows.collect()}
    plain = estimate.chapman(spark.createDataFrame([(35, 29, 20, 60)], "n1 long, n2 long, m long, n_observed long")).collect()[0]
    assert (by["chapman"].estimable, by["chapman"].n_hat) == (plain.estimable, plain.n_hat)
    plain = estimate.chao1(spark.createDataFrame([(51, 22, 29)], "s_obs long, f1 long, f2 long")).collect()[0]
    assert by["chao1"].n_hat == plain.n_hat and by["chao1"].n_hat_high == plain.n_hat_high
    got = studies.coverage_loglinear(h, history, list("abc")).collect()[0]
    want = plain_versions.loglinear({"110": 20, "100": 15, "011": 9, "001": 7, "010": 0, "101": 0, "111": 0})
    assert (got.estimable, got.n_hat) == (want["estimable"], want["n_hat"])
    total = {r.estimator: r for r in studies.coverage_summary(rows, 55).collect()}
    assert total["chao1"].coverage == float(by["chao1"].n_hat_low <= 55 <= by["chao1"].n_hat_high) and total["chao1"].cells == 1
    assert studies.coverage_rows(studies.capture_counts(h, list("abc")), history, least=61).count() == 0


def test_recall_rule_fires_where_arms_overlap(spark):
    curve = spark.createDataFrame([("t", n, 10 * n, 90 + n, 0.9 + n / 100) for n in (1, 2, 3, 4)], CURVE)
    counts = [("t", n, 85 + n, 84 + n, 80 + n) for n in (1, 2, 3, 4)]
    one = studies.overlap_reviews(spark.createDataFrame(counts, "trial string, n int, n1 long, n2 long, m long"), curve, 0.9).collect()[0]
    assert one.fired_at == 3 and math.isclose(one.recall_at_fire, 0.93) and one.mean_overlap > 0.85
    few = [("t", n, 50 + n, 20 + n, 3) for n in (1, 2, 3, 4)]
    assert studies.overlap_reviews(spark.createDataFrame(few, "trial string, n int, n1 long, n2 long, m long"), curve, 0.9).collect()[0].fired_at is None


def test_predictions(spark):
    ddl = "case string, recall double, unresolvable long, identified long, iterations long, included long, captured long, saturation boolean"
    cases = spark.createDataFrame([("bad", 0.5, 4, 10, 3, 20, 8, True), ("good", 0.8, 4, 20, 5, 20, None, None), ("other", 0.1, 0, 0, 1, 0, 0, True)], ddl)
    rows = {r.prediction: (r.testable, r.held) for r in studies.predictions(cases, "bad", "good").collect()}
    assert rows == {"recall is lower": (True, True), "more is unresolvable": (True, True), "fewer rounds": (False, None), "less is captured": (False, False)}


def test_boolean_seeds(spark):
    gold = spark.createDataFrame([("a", 1, 2000), ("b", 2, 2001), ("c", 3, 2002)], "key string, cited_by long, year int")
    pool = spark.createDataFrame([("c", 1), ("z", 2), ("b", 3), ("c", 9)], "key string, place int")
    keys = lambda df: [r.key for r in df.collect()]
    assert keys(simulate.select_seeds(gold, "boolean", 1, pool=pool)) == ["c"]
    assert keys(simulate.select_seeds(gold, "boolean", 5, pool=pool)) == ["b", "c"]
    assert keys(simulate.select_seeds(gold, "boolean", 2, pool=pool.where("key = 'z'"))) == ["a", "b"]
    assert keys(simulate.select_seeds(gold, "boolean", 2)) == ["a", "b"]


def test_kappa_interval_and_controls(spark):
    pairs = spark.createDataFrame([(True, True)] * 40 + [(False, False)] * 40 + [(True, False)] * 20, "a boolean, b boolean")
    r = stats.agreement(pairs).collect()[0]
    po, pe = 0.8, 0.6 * 0.4 + 0.4 * 0.6
    half = 1.96 * math.sqrt(po * (1 - po) / (100 * (1 - pe) ** 2))
    assert math.isclose(r.kappa, (po - pe) / (1 - pe)) and math.isclose(r.kappa_high - r.kappa, half) and math.isclose(r.kappa - r.kappa_low, half)
    rows = [(s, True) for s in (1.0, 8.0, 8.0, 9.0)] + [(s, False) for s in (2.0, 3.0, 8.0)]
    c = stats.blind_controls(spark.createDataFrame(rows, "score double, positive boolean"), 7).collect()[0]
    area = lambda pos, neg: sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert math.isclose(c.auc, area([1, 8, 8, 9], [2, 3, 8])) and math.isclose(c.auc_trimmed, area([8, 8, 9], [2, 3, 8]))
    assert (c.n_excluded, c.positives_at_tau) == (1, 3) and math.isclose(c.include_rate, 1 / 3)


def test_between_families_equals_the_whole_table(spark):
    scores = [(k, r, float((k * m) % 10)) for k in range(30) for r, m in (("a1", 3), ("a2", 3), ("b1", 7))] + [(99, "a1", 5.0)]
    df = spark.createDataFrame(scores, "key long, rater string, score double")
    got = stats.between_families(df, F.substring("rater", 1, 1)).collect()[0]
    means = stats.common_basis(df).groupBy("key", F.substring("rater", 1, 1).alias("rater")).agg(F.avg("score").alias("score"))
    want = stats.icc21(means).collect()[0]
    assert (got.first, got.second, got.n) == ("a", "b", want.n) and math.isclose(got.icc, want.icc, abs_tol=1e-9)


def test_families_meet_in_as_many_tasks_as_their_scores_need(spark, monkeypatch):
    """Keys are dealt once, to more tasks where there are more scores, and the result is the same."""
    df = spark.createDataFrame([(k, r, float((k * m) % 10)) for k in range(30) for r, m in (("a1", 3), ("a2", 4), ("b1", 7))], "key long, rater string, score double")
    want = stats.between_families(df, F.substring("rater", 1, 1)).collect()
    monkeypatch.setattr(storage, "DEAL", 5)
    got = stats.between_families(df, F.substring("rater", 1, 1))
    by_key = re.findall(r"hashpartitioning\(key#\d+L?, (\d+)\)", got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString())
    assert by_key and set(by_key) == {"18"}
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got.collect()] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want]


def test_rule_order_is_the_settings_order(spark):
    rows = [("t", 1, r, True, False) for r in ("budget", "marginal_yield")]
    d = stopping.rule_set(spark.createDataFrame(rows, "trial string, n int, rule string, triggered boolean, advisory boolean"), ["marginal_yield", "budget"]).collect()[0]
    assert d.stop and d.stopped_by == "marginal_yield"


def test_leave_one_out_equals_a_centroid_of_the_others(spark):
    texts = {"a": "graph citation graph search", "b": "citation search recall", "c": "whale ocean the study", "d": None, "z": "graph whale"}
    docs = spark.createDataFrame(list(texts.items()), "key string, text string").select("key", stats.screening_terms(F.col("text")).alias("terms"))
    assert {r.key: r.terms for r in docs.collect()}["c"] == ["whale", "ocean"]
    weights = stats.tfidf(docs)
    core = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    got = {r.key: r.similarity for r in stats.seed_leave_one_out(weights, core).collect()}
    for k in "abc":
        others = core.where(F.col("key") != k)
        want = {r.key: r.similarity for r in stats.topic_similarity(weights, others).collect()}[k]
        assert math.isclose(got[k], want, abs_tol=1e-9)
    assert got["d"] == 0.0 and stats.seed_leave_one_out(weights, core.limit(2)).count() == 0


def test_trials_join_lines_once_and_coverage_needs_no_later_round(spark):
    """Edges and curve are read from what was written; rows of coverage are those of the crawl to saturation."""
    from citeweft.plans import studies as plans

    d = "/root/testdata/sf0.001"
    found, curve, e, _ = plans._trials(spark, d)
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in (e, curve))
    counts = studies.capture_counts(plans._histories(found, curve, e), list("abc"))
    whole = studies.coverage_rows(counts, curve, plans.DEPTH)
    got = plans._coverage(spark, d)[0]
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert plans._trials(spark, d, plans.DEPTH)[0].where(f"n > {plans.DEPTH}").isEmpty()
