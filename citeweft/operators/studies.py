"""Studies on crawls with a known answer: trials, coverage of the estimators, stops scored by curves, predictions across cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import estimate, loglinear, simulate, stopping


def first_captures(found: DataFrame, edges: DataFrame, arms: dict[str, Column]) -> DataFrame:
    """(trial, a column for each arm, works): included works by the round in which each arm first captured them.

    found (trial, key, n, included), edges (src, dst) with the columns that the arms test. A way counts once both of its
    ends are known, the parent a round earlier; null: never. A work's history changes at most once for each arm, so these
    counts give the histories of every round without a row for each work and round.
    """
    inc = found.where("included").select("trial", "key", F.col("n").alias("born"))
    parents = inc.select("trial", F.col("key").alias("src"), (F.col("born") + 1).alias("at"))
    ways = edges.join(parents, "src").join(inc.withColumnRenamed("key", "dst"), ["trial", "dst"])
    seen = F.greatest("born", "at")
    firsts = ways.groupBy("trial", "dst").agg(*(F.min(F.when(test, seen)).alias(name) for name, test in arms.items()))
    return firsts.where(F.coalesce(*arms).isNotNull()).groupBy("trial", *arms).agg(F.count("*").alias("works"))


def by_round(firsts: DataFrame, rounds: DataFrame, arms: list[str]) -> DataFrame:
    """(trial, n, a boolean for each arm, works): the histories as they stood after each round of rounds (trial, n)."""
    alive = firsts.join(rounds.select("trial", "n"), "trial").where(F.least(*arms) <= F.col("n"))
    return alive.select("trial", "n", *(F.coalesce(F.col(a) <= F.col("n"), F.lit(False)).alias(a) for a in arms), "works")


def capture_counts(histories: DataFrame, arms: list[str]) -> DataFrame:
    """n1, n2, m of the first two arms and s_obs, f1, f2 over all, by trial and round."""
    a, b = F.col(arms[0]), F.col(arms[1])
    k = sum((F.col(x).cast("int") for x in arms[1:]), F.col(arms[0]).cast("int"))
    tally = lambda test: F.sum(F.when(test, F.col("works")).otherwise(0))
    return histories.groupBy("trial", "n").agg(tally(a).alias("n1"), tally(b).alias("n2"), tally(a & b).alias("m"), F.sum("works").alias("s_obs"), tally(k == 1).alias("f1"), tally(k == 2).alias("f2"))


def until_stop(history: DataFrame, decided: DataFrame) -> DataFrame:
    """history up to each trial's first stop, with ``stopped_by``; decided (trial, n, stop, stopped_by).

    Screening has a known answer, so that a crawl which stops is the start of the one that goes on.
    """
    stop = decided.where("stop").groupBy("trial").agg(F.min("n").alias("last"), F.min_by("stopped_by", "n").alias("stopped_by"))
    return history.join(stop, "trial", "left").where("last is null or n <= last").drop("last")


def trial_results(curve: DataFrame, estimates: DataFrame) -> DataFrame:
    """A row for each trial: n_found, final_recall, iterations, total_screened, stopped_by, burdens, estimated_recall.

    curve: the recall curve of what ``until_stop`` left; estimates (trial, n, recall) as they stood after each round.
    """
    ends = curve.groupBy("trial").agg(
        F.max("cumulative_included").alias("n_found"),
        F.max("recall").alias("final_recall"),
        F.count("*").alias("iterations"),
        F.max("cumulative_screened").alias("total_screened"),
        F.first("stopped_by", ignorenulls=True).alias("stopped_by"),
        F.max("n").alias("n"),
        *(F.min(F.when(F.col("recall") >= t / 100, F.col("cumulative_screened"))).alias(f"burden_{t}") for t in (80, 90, 95)),
    )
    return ends.join(estimates.select("trial", "n", F.col("recall").alias("estimated_recall")), ["trial", "n"], "left").drop("n")


def benchmark_summary(results: DataFrame) -> DataFrame:
    """n_trials and mean_final_recall of ``trial_results``, with the calibration of their estimates."""
    errors = simulate.calibration(results.select(F.col("estimated_recall").alias("estimated"), F.col("final_recall").alias("true")))
    return results.agg(F.count("*").alias("n_trials"), F.coalesce(F.avg("final_recall"), F.lit(0.0)).alias("mean_final_recall")).join(errors.withColumnRenamed("n", "n_estimated"))


def _deep_enough(rows: DataFrame, history: DataFrame, depth: int, least: int) -> DataFrame:
    known = history.select("trial", "n", F.col("cumulative_included").alias("n_observed"))
    return rows.join(known, ["trial", "n"]).where((F.col("n") <= depth) & (F.col("n_observed") >= least))


def coverage_rows(counts: DataFrame, history: DataFrame, depth: int = 6, least: int = 4) -> DataFrame:
    """(trial, n, estimator, estimable, n_hat, n_hat_low, n_hat_high) of Chapman and Chao for each round up to ``depth``.

    Rounds with fewer than ``least`` included works or no capture have no row.
    """
    base = _deep_enough(counts, history, depth, least)
    out = ("estimable", "n_hat", "n_hat_low", "n_hat_high")
    return estimate.chapman(base).select("trial", "n", F.lit("chapman").alias("estimator"), *out).union(estimate.chao1(base).select("trial", "n", F.lit("chao1"), *out))


def coverage_loglinear(histories: DataFrame, history: DataFrame, arms: list[str], depth: int = 6, least: int = 4) -> DataFrame:
    """As ``coverage_rows`` for the log-linear model, which has no interval; all models of all rounds are fitted at once."""
    bits = F.concat(*(F.when(F.col(a), "1").otherwise("0") for a in arms))
    cells = _deep_enough(histories.groupBy("trial", "n", bits.alias("pattern")).agg(F.sum("works").alias("works")), history, depth, least)
    got = loglinear.select(loglinear.table_of(cells, len(arms), ("trial", "n"), "works"), len(arms))
    none = F.lit(None).cast("double")
    return got.select("trial", "n", F.lit("loglinear").alias("estimator"), "estimable", "n_hat", none.alias("n_hat_low"), none.alias("n_hat_high"))


def coverage_summary(rows: DataFrame, truth: int) -> DataFrame:
    """(estimator, cells, estimable, relative_bias, coverage): against the known number; coverage of the intervals given."""
    ok = F.col("estimable")
    inside = F.lit(truth).between(F.col("n_hat_low"), F.col("n_hat_high"))
    bias = F.avg(F.when(ok, (F.col("n_hat") - truth) / float(max(1, truth))))
    return rows.groupBy("estimator").agg(F.count("*").alias("cells"), F.count_if(ok).alias("estimable"), bias.alias("relative_bias"), F.avg(F.when(ok & F.col("n_hat_low").isNotNull(), inside.cast("double"))).alias("coverage"))


def asymptote_grid(history: DataFrame, tau: float = 0.95, min_points: int = 4) -> DataFrame:
    """(trial, n, rule, triggered, value): share of the asymptote fitted over a grid to the rounds so far.

    The asymptote goes from the includes so far to three times as many in 80 steps, the rate from 0.05 to 3 in 60; ties go
    to the smaller asymptote, then the smaller rate. Squared errors come from running sums for each rate, so that no round
    is fitted anew and nothing leaves the JVM.
    """
    y = F.col("y")
    rated = history.select("trial", "n", F.col("cumulative_included").cast("double").alias("y")).withColumn("rate", F.explode(F.sequence(F.lit(1), F.lit(60))))
    rated = rated.withColumn("g", 1 - F.exp(F.lit(-0.05) * F.col("rate") * F.col("n")))
    w = Window.partitionBy("trial", "rate").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sums = rated.select("trial", "n", "rate", "y", F.count("*").over(w).alias("points"), F.sum(F.col("g") * F.col("g")).over(w).alias("gg"), F.sum(F.col("g") * y).over(w).alias("gy"), F.sum(y * y).over(w).alias("yy"))
    grid = sums.where((F.col("points") >= min_points) & (y > 0)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(80))))
    top = y * (1 + F.col("step") / 40)
    best = grid.groupBy("trial", "n").agg(F.min_by(y / top, F.struct((top * top * F.col("gg") - 2 * top * F.col("gy") + F.col("yy")).alias("error"), "step", "rate")).alias("value"))
    return history.select("trial", "n").join(best, ["trial", "n"], "left").select("trial", "n", F.lit("asymptote_grid").alias("rule"), F.coalesce(F.col("value") >= tau, F.lit(False)).alias("triggered"), "value")


def curve_outcomes(curve: DataFrame, fired: DataFrame, target: float = 0.95) -> DataFrame:
    """(trial, rule, fired_at, optimal_n, recall_at_stop, overshoot, excess, missed, regret): stops against a whole crawl.

    optimal_n is null where the target is never reached; missed and regret count against the crawl's end.
    """
    there = F.col("recall") >= target
    ends = curve.groupBy("trial").agg(F.min(F.when(there, F.col("n"))).alias("optimal_n"), F.min(F.when(there, F.col("cumulative_screened"))).alias("least"), F.max("recall").alias("ceiling"), F.max("cumulative_included").alias("all"))
    at = curve.select("trial", F.col("n").alias("fired_at"), F.col("recall").alias("recall_at_stop"), "cumulative_screened", "cumulative_included")
    rows = fired.select("trial", "rule", "fired_at").join(at, ["trial", "fired_at"], "left").join(ends, "trial")
    return rows.select("trial", "rule", "fired_at", "optimal_n", "recall_at_stop", (F.col("fired_at") - F.col("optimal_n")).alias("overshoot"), (F.col("cumulative_screened") - F.col("least")).alias("excess"), (F.col("all") - F.col("cumulative_included")).alias("missed"), (F.col("ceiling") - F.col("recall_at_stop")).alias("regret"))


def overlap_reviews(counts: DataFrame, curve: DataFrame, tau: float = 0.95, **rule) -> DataFrame:
    """(trial, mean_overlap, fired_at, recall_at_fire, reachable): does the recall rule fire at this overlap of two arms?

    counts by trial and round; ``rule`` goes to the stopping rule. A trial without any capture has overlap 0.
    """
    trail = estimate.chapman(counts.withColumn("n_observed", F.col("n1") + F.col("n2") - F.col("m")))
    fired = stopping.first_fired(stopping.recall_stability(trail, tau, **rule)).select("trial", "fired_at")
    shares = counts.groupBy("trial").agg(F.avg(F.try_divide(F.col("m"), F.col("n1") + F.col("n2") - F.col("m"))).alias("mean_overlap"))
    ends = curve.groupBy("trial").agg(F.max("recall").alias("reachable"))
    at = curve.select("trial", F.col("n").alias("fired_at"), F.col("recall").alias("recall_at_fire"))
    rows = ends.join(shares, "trial", "left").withColumn("mean_overlap", F.coalesce("mean_overlap", F.lit(0.0)))
    return rows.join(fired, "trial", "left").join(at, ["trial", "fired_at"], "left")


def overlap_summary(reviews: DataFrame) -> DataFrame:
    """(setting, reviews, mean_overlap, fired, recall_at_fire, reachable) of reviews with their setting."""
    return reviews.groupBy("setting").agg(F.count("*").alias("reviews"), F.avg("mean_overlap").alias("mean_overlap"), F.count("fired_at").alias("fired"), F.avg("recall_at_fire").alias("recall_at_fire"), F.avg("reachable").alias("reachable"))


def predictions(cases: DataFrame, adverse: str, favourable: str) -> DataFrame:
    """(prediction, adverse, favourable, testable, held): four directions registered before the cases were run.

    cases (case, recall, unresolvable, identified, iterations, included, captured, saturation), a row for each case. A
    direction is testable where both sides have a value; that of the rounds is only reported, and testable where it is
    known whether the favourable case was saturated.
    """
    c = {x: F.col(x).cast("double") for x in ("recall", "unresolvable", "identified", "iterations", "included", "captured")}
    share = lambda a, b: F.try_divide(c[a], c[b])
    each = [("recall is lower", c["recall"], -1), ("more is unresolvable", share("unresolvable", "identified"), 1), ("fewer rounds", c["iterations"], 0), ("less is captured", share("captured", "included"), -1)]
    rows = cases.select("case", "saturation", F.inline(F.array(*(F.struct(F.lit(p).alias("prediction"), v.alias("value"), F.lit(s).alias("sign")) for p, v, s in each))))
    side = lambda col, name: F.max(F.when(F.col("case") == name, F.col(col)))
    both = rows.groupBy("prediction", "sign").agg(side("value", adverse).alias("adverse"), side("value", favourable).alias("favourable"), side("saturation", favourable).alias("saturation"))
    given = F.col("adverse").isNotNull() & F.col("favourable").isNotNull()
    held = F.when(F.col("sign") != 0, F.coalesce((F.col("adverse") - F.col("favourable")) * F.col("sign") > 0, F.lit(False)))
    return both.select("prediction", "adverse", "favourable", F.when(F.col("sign") == 0, F.col("saturation").isNotNull()).otherwise(given).alias("testable"), held.alias("held"))
