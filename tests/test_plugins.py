"""Rules and rankers that a user adds; the crawl over buckets."""

from __future__ import annotations

import pandas as pd
import pytest
from citeweft import settings
from citeweft.model import WORKS_DDL, DedupSettings, RunSettings
from citeweft.operators import expand, rank, stopping, studies
from citeweft.run import Run
from citeweft.storage import Bucketed
from pyspark.sql import functions as F

H = "trial string, n int, n_screened long, n_included long, cumulative_screened long, cumulative_included long, frontier_size long, yield_rate double"


@pytest.fixture(scope="module")
def history(spark):
    rows = [(t, n, 10, i, 10 * n, i * n, 5, i / 10) for t, yields in (("a", [9, 8, 2, 1]), ("b", [5, 5, 5, 5])) for n, i in enumerate(yields, 1)]
    return spark.createDataFrame(rows, H)


def test_rule_from_a_grouped_function(spark, history):
    """The middle of the last three yields, as a pandas aggregate over a window; it stops one trial and not the other."""

    @F.pandas_udf("double")
    def middle(v: pd.Series) -> float:
        return float(v.median())

    stopping.register("low_middle", stopping.window_rule("low_middle", lambda w: middle("yield_rate").over(w), lambda v: v < 0.3, 0.3, rounds=3, least=3))
    said = stopping.evaluate(history, None, {"low_middle": {}, "exhaustion": {}})
    fired = {(r.trial, r.n): (r.triggered, r.value) for r in said.where("rule = 'low_middle'").collect()}
    assert fired["a", 2] == (False, None) and fired["a", 3] == (False, 0.8) and fired["a", 4] == (True, 0.2) and not any(fired["b", n][0] for n in (1, 2, 3, 4))
    stopped = studies.until_stop(history, stopping.rule_set(said, ["low_middle"]))
    assert {r.stopped_by for r in stopped.where("trial = 'a'").collect()} >= {"low_middle"}
    assert {r.triggered for r in stopping.evaluate(history, None, {"low_middle": {"threshold": 0.9}}).collect()} == {True, False}


def test_rules_keep_to_their_contract(spark, history):
    good = stopping.window_rule("odd", lambda w: F.max("n").over(w), lambda v: v > 3, 3)
    with pytest.raises(stopping.RuleError, match="own"):
        stopping.register("budget", good)
    for make, why in (
        (lambda h, t: good(h).drop("value"), "value"),
        (lambda h, t: good(h).where("n > 1"), "round 1"),
        (lambda h, t: good(h).union(good(h)), "round"),
        (lambda h, t: good(h).withColumn("rule", F.lit("budget")), "round"),
        (lambda h, t: good(h).withColumn("triggered", F.lit(None).cast("boolean")), "round"),
    ):
        stopping.register("odd", make)
        with pytest.raises(stopping.RuleError, match=why):
            stopping.evaluate(history, None, {"odd": {}})
    with pytest.raises(stopping.RuleError, match="no rule"):
        stopping.evaluate(history, None, {"unheard of": {}})
    with pytest.raises(settings.SettingsError, match="no rules"):
        settings.check(RunSettings(rules=(("unheard of", {}),)))


def test_a_run_with_a_rule_and_a_ranker_of_ones_own(spark):
    """The ranker orders candidates backwards by key, the rule stops after two rounds."""
    keys = [f"w{k}" for k in range(8)]
    works = spark.createDataFrame([(k, f"title of {k}", f"title of {k}", f"10.1000/{k}", None, 2000, [(f"s{k}", None, None)], None, "article", "en", False, False, {}, None, None, []) for k in keys], WORKS_DDL)
    edges = spark.createDataFrame([(keys[i], keys[j], "backward", "x") for i, j in ((0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (5, 6), (6, 7))], "src string, dst string, direction string, provider string")
    stopping.register("two_rounds", stopping.window_rule("two_rounds", lambda w: F.max("n").over(w), lambda v: v >= 2, 2))
    rank.register("backwards", lambda inc, cand, prov, vec: cand.select("key", F.substring("key", 2, 9).cast("double").alias("score")))
    run = Run(works, edges, RunSettings(ranker="backwards", rules=(("two_rounds", {}),)))
    run.init(spark.createDataFrame([("w0",)], "ident string"))
    orders = []

    def screen(pending):
        orders.append([r.key for r in pending.orderBy("rank").collect()])
        return pending.select("key", F.lit("include").alias("decision"))

    run.run_to_saturation(screen)
    assert orders == [["w2", "w1"], ["w4", "w3"]] and run.stopped_by == "two_rounds" and run.n == 2


def test_rankers_keep_to_their_contract(spark):
    cand = spark.createDataFrame([("a",), ("b",)], "key string")
    with pytest.raises(rank.RankerError, match="own"):
        rank.register("bm25", lambda *_: cand)
    rank.register("partial", lambda inc, c, p, v: spark.createDataFrame([("a", 2.0), ("zz", 9.0), ("b", float("nan"))], "key string, score double"))
    assert sorted(map(tuple, rank.build("partial")(None, cand, None, None).collect())) == [("a", 2.0), ("b", 0.0)]
    rank.register("scoreless", lambda inc, c, p, v: c)
    with pytest.raises(rank.RankerError, match="score"):
        rank.build("scoreless")(None, cand, None, None)


def test_rounds_move_no_edges(spark):
    """A round's plan deals its frontier, its finds and what is known: no exchange stands above the scan of the edges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = spark.range(2000).select((F.col("id") % 97).alias("src"), (F.col("id") % 89).alias("dst"), F.lit(True).alias("included")).distinct()
        step = Bucketed(edges, "src")
        found = spark.createDataFrame([("t", 1, 0, True)], "trial string, key long, n int, included boolean")
        new = expand.one_round(step.read(), found, found, 1)
        plan = new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Bucketed: true") == 1
    assert new.count() == len({r.dst for r in edges.where("src = 1").collect()} - {1})
    step.close()


def test_co_citation_counts_shared_parents(spark):
    prov = spark.createDataFrame([("c", "p", "backward"), ("c", "q", "backward"), ("i", "p", "backward"), ("j", "p", "forward"), ("j", "q", "forward"), ("i", "p", "forward"), ("k", "r", "backward")], "key string, parent string, direction string")
    inc = spark.createDataFrame([("i",), ("j",)], "key string")
    cand = spark.createDataFrame([("c",), ("i",), ("k",)], "key string")
    assert {r.key: r.cocitation for r in rank.network_features(prov, cand, inc).collect()} == {"c": 3, "i": 1, "k": 0}


def test_seeds_go_to_the_first_provider_in_order(spark):
    """One DOI at two providers under different keys; the order of precedence decides which work is the seed."""
    rows = [("w1", "10.1000/x", [("b", None, None)]), ("w2", "10.1000/x", [("a", None, None)]), ("w3", None, [])]
    works = spark.createDataFrame([(k, k, k, d) for k, d, _ in rows], "key string, title string, title_norm string, doi string")
    prov = spark.createDataFrame([(k, p[0][0] if p else None) for k, _, p in rows], "key string, provider string")
    full = spark.createDataFrame([], WORKS_DDL)
    kinds = dict(full.dtypes)
    w = works.join(prov, "key")
    for c in full.columns:
        if c == "provenance":
            names = [x.split(":")[0] for x in kinds[c][len("array<struct<") : -2].split(",")]
            one = F.struct(*(F.col("provider").alias(n) if n == "provider" else F.lit(None).cast("string").alias(n) for n in names))
            w = w.withColumn(c, F.when(F.col("provider").isNotNull(), F.array(one)).otherwise(F.array()).cast(kinds[c]))
        elif c not in w.columns:
            w = w.withColumn(c, F.lit(None).cast(kinds[c]))
    edges = spark.createDataFrame([], "src string, dst string, direction string, provider string")
    for order, want in ((("a", "b"), {"w2", "w3"}), (("b", "a"), {"w1", "w3"})):
        run = Run(w.select(full.columns), edges, RunSettings(dedup=DedupSettings(precedence=order)))
        assert run.init(spark.createDataFrame([("https://doi.org/10.1000/X",), ("W3",), ("nobody",)], "ident string")) == 2
        assert {r.key for r in run.decisions.collect()} == want
