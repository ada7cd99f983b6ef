"""Capture histories and the population estimates from them."""

from __future__ import annotations

from itertools import combinations
from math import erfc, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Arm
from . import loglinear

MIN_OVERLAP = 3


def arm_predicate(arm: Arm, members: set[str] = frozenset()) -> Column:
    """Whether a provenance row belongs to an arm; columns direction, provider, member sets as ``sets``."""
    out = F.lit(True)
    if arm.directions:
        out = out & F.col("direction").isin(*arm.directions)
    if arm.providers:
        out = out & F.col("provider").isin(*arm.providers)
    if arm.member_of is not None:
        if arm.member_of not in members:
            raise KeyError(f"no membership set {arm.member_of!r}")
        out = out & F.array_contains("sets", arm.member_of)
    for name, value in sorted(arm.equals.items()):
        out = out & (F.col(name) == value)
    return out


def with_sets(provenance: DataFrame, members: dict[str, DataFrame]) -> DataFrame:
    """Provenance with ``sets``, the names of the membership sets (key) that hold a row's key."""
    if not members:
        return provenance
    named = None
    for name, keys in sorted(members.items()):
        one = keys.select("key", F.lit(name).alias("name"))
        named = one if named is None else named.union(one)
    return provenance.join(named.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("sets")), "key", "left")


def capture_histories(provenance: DataFrame, included: DataFrame, arms: dict[str, Column]) -> DataFrame:
    """(key, one boolean column for each arm) of the included works that an arm captured."""
    rows = provenance.join(included.select("key"), "key", "left_semi")
    found = rows.groupBy("key").agg(*(F.bool_or(F.coalesce(test, F.lit(False))).alias(name) for name, test in arms.items()))
    any_ = F.lit(False)
    for name in arms:
        any_ = any_ | F.col(name)
    return found.where(any_)


def cells(histories: DataFrame, arms: list[str]) -> DataFrame:
    """(pattern, n) for every pattern of captures but the empty one; 0 where none was seen."""
    bits = F.concat(*(F.when(F.col(a), "1").otherwise("0") for a in arms))
    seen = histories.groupBy(bits.alias("pattern")).agg(F.count("*").alias("n"))
    k = len(arms)
    every = histories.sparkSession.range(1, 1 << k).select(F.lpad(F.bin("id"), k, "0").alias("pattern"))
    return every.join(seen, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def overlap(histories: DataFrame, arms: list[str]) -> DataFrame:
    """n1, n2, m of the first two arms; n_observed over all."""
    a, b = F.col(arms[0]), F.col(arms[1])
    return histories.agg(F.count_if(a).alias("n1"), F.count_if(b).alias("n2"), F.count_if(a & b).alias("m"), F.count("*").alias("n_observed"))


def lincoln_petersen(counts: DataFrame) -> DataFrame:
    return counts.withColumn("n_hat", F.when(F.col("m") > 0, F.col("n1") * F.col("n2") / F.col("m")))


def chapman(counts: DataFrame, z: float = 1.96) -> DataFrame:
    """n_hat, se, interval and recall from (n1, n2, m, n_observed); ``reason`` says why there is none."""
    n1, n2, m, seen = (F.col(c).cast("double") for c in ("n1", "n2", "m", "n_observed"))
    raw = (n1 + 1) * (n2 + 1) / (m + 1) - 1
    why = F.when(m < MIN_OVERLAP, "overlap_below_minimum").when((n1 <= 0) | (n2 <= 0), "empty_arm").when(raw <= seen, "nested_arms")
    rows = counts.withColumn("reason", why)
    ok = F.col("reason").isNull()
    var = (n1 + 1) * (n2 + 1) * (n1 - m) * (n2 - m) / ((m + 1) * (m + 1) * (m + 2))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    lo = F.greatest(seen, raw - z * se)
    hi = F.greatest(lo, raw + z * se)
    given = {"n_hat": raw, "se": se, "n_hat_low": lo, "n_hat_high": hi, "recall": F.least(F.lit(1.0), seen / raw), "recall_low": F.least(F.lit(1.0), seen / hi), "recall_high": F.least(F.lit(1.0), seen / lo)}
    return rows.withColumn("estimable", ok).withColumns({k: F.when(ok, v) for k, v in given.items()})


def frequencies(histories: DataFrame, arms: list[str]) -> DataFrame:
    """s_obs, f1, f2: works seen, seen by one arm, by two."""
    n = sum((F.col(a).cast("int") for a in arms[1:]), F.col(arms[0]).cast("int"))
    return histories.agg(F.count("*").alias("s_obs"), F.count_if(n == 1).alias("f1"), F.count_if(n == 2).alias("f2"))


def chao1(counts: DataFrame, z: float = 1.96) -> DataFrame:
    """Chao's lower bound from (s_obs, f1, f2), with the log interval."""
    s, f1, f2 = (F.col(c).cast("double") for c in ("s_obs", "f1", "f2"))
    why = F.when(s == 0, "no_records").when((f2 == 0) & (f1 == s), "all_singletons")
    r = F.try_divide(f1, f2)
    some = f2 > 0
    n_hat = F.when(f1 == 0, s).when(some, s + f1 * f1 / (2 * F.nullif(f2, F.lit(0.0)))).otherwise(s + f1 * (f1 - 1) / 2)
    var = F.when(some, f2 * (0.5 * r * r + r * r * r + 0.25 * r * r * r * r)).otherwise(0.5 * f1 * (f1 - 1) + 0.25 * f1 * (2 * f1 - 1) * (2 * f1 - 1) - F.try_divide(f1 * f1 * f1 * f1, 4 * n_hat))
    rows = counts.withColumn("reason", why).withColumn("n_hat", F.when(why.isNull(), n_hat)).withColumn("se", F.when(why.isNull(), F.when(f1 == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))))
    n, se = F.col("n_hat"), F.col("se")
    open_ = (n > s) & (se > 0)
    c = F.exp(z * F.sqrt(F.log(1 + F.try_divide(se * se, (n - s) * (n - s)))))
    lo = F.when(open_, s + (n - s) / c).otherwise(s)
    hi = F.when(f1 == 0, s).when(open_, s + (n - s) * c).otherwise(n + z * se)
    ok = F.col("reason").isNull()
    return rows.withColumns({"estimable": ok, "n_hat_low": F.when(ok, lo), "n_hat_high": F.when(ok, hi), "recall": F.when(ok, F.least(F.lit(1.0), s / n))})


def odds(histories: DataFrame, arms: list[str], least: int = 10) -> DataFrame:
    """For each pair of arms, among works captured by another arm: the 2x2 counts, odds ratio, Yates chi-square, n.

    Pairs with fewer than ``least`` such works are left out.
    """
    structs = []
    for a, b in combinations(arms, 2):
        other = F.lit(False)
        for c in arms:
            if c not in (a, b):
                other = other | F.col(c)
        x, y = F.col(a), F.col(b)
        structs += [F.count_if(other & t).alias(f"{a}_{b}_{n}") for n, t in (("both", x & y), ("first", x & ~y), ("second", ~x & y), ("none", ~x & ~y))]
    one = histories.agg(*structs)
    rows = F.array(*(F.struct(F.lit(a).alias("first_arm"), F.lit(b).alias("second_arm"), *(F.col(f"{a}_{b}_{n}").cast("double").alias(s) for n, s in (("both", "a"), ("first", "b"), ("second", "c"), ("none", "d")))) for a, b in combinations(arms, 2)))
    long = one.select(F.inline(rows)).withColumn("n", F.expr("a + b + c + d")).where(F.col("n") >= least)
    ratio = F.expr("(a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))")
    chi = F.expr("coalesce(try_divide(n * power(greatest(abs(a * d - b * c) - n / 2, 0), 2), (a + b) * (c + d) * (a + c) * (b + d)), 0D)")
    return long.withColumn("odds_ratio", ratio).withColumn("chi_square", chi)


def p_value(chi_square: float) -> float:
    """Of chi-square with one degree of freedom."""
    return erfc(sqrt(chi_square / 2))


def dependence(rows: DataFrame, alpha: float = 0.05) -> list[str]:
    """Warnings from ``odds``: pairs of arms that are not independent (a row for each pair of arms)."""
    out = []
    for r in rows.collect():
        if p_value(r.chi_square) < alpha and (r.odds_ratio > 1.2 or r.odds_ratio < 0.83):
            kind = "positively" if r.odds_ratio > 1 else "negatively"
            out.append(f"{r.first_arm} and {r.second_arm} are {kind} dependent (OR {r.odds_ratio:.2f})")
    return out


def strata(works: DataFrame, arms_per_work: DataFrame) -> DataFrame:
    """(dimension, stratum, n, mean_arms) by year (at the upper median), language and type.

    works (key, year, language, type), arms_per_work (key, n_arms).
    """
    rows = works.join(arms_per_work, "key")
    years = rows.where("year is not null")
    # the median by counting values, so that no task gathers all works
    by_year = years.groupBy("year").agg(F.count("*").alias("n"))
    up = by_year.withColumn("upto", F.sum("n").over(Window.orderBy("year"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    median = up.where("upto > floor(total / 2)").agg(F.min("year").alias("median"))
    y = years.join(F.broadcast(median)).select(F.lit("year").alias("dimension"), F.when(F.col("year") < F.col("median"), "older").otherwise("newer").alias("stratum"), "n_arms")
    lang = rows.select(F.lit("language"), F.when(F.coalesce("language", F.lit("")) == "", "unknown").when(F.col("language") == "en", "en").otherwise("non-en"), "n_arms")
    kind = rows.select(F.lit("type"), F.when(F.coalesce("type", F.lit("")) == "", "unknown").otherwise(F.col("type")), "n_arms")
    return y.union(lang).union(kind).groupBy("dimension", "stratum").agg(F.count("*").alias("n"), F.avg("n_arms").alias("mean_arms"))


def heterogeneity(rows: DataFrame, limit: float = 0.25) -> DataFrame:
    """(dimension, lowest, highest, flagged) over ``strata``."""
    return rows.groupBy("dimension").agg(F.min("mean_arms").alias("lowest"), F.max("mean_arms").alias("highest")).withColumn("flagged", F.coalesce(F.try_divide(F.col("highest") - F.col("lowest"), F.col("highest")) > limit, F.lit(False)))


def trial_captures(found: DataFrame, trials: list[str]) -> DataFrame:
    """Capture histories with trials as arms, for crawls from split seeds: (key, a boolean column for each trial)."""
    inc = found.where("included")
    return inc.groupBy("key").agg(*(F.bool_or(F.col("trial") == t).alias(t) for t in trials))


def estimate_recall(histories: DataFrame, arms: list[str], method: str = "chapman") -> dict:
    """One estimate as a dictionary; fewer than two arms are refused. Chapman goes by the first two arms."""
    if len(arms) < 2:
        return {"method": method, "estimable": False, "reason": "fewer_than_two_arms"}
    if method == "chapman":
        found = chapman(overlap(histories, arms)).collect()[0].asDict()
    elif method == "chao1":
        found = chao1(frequencies(histories, arms)).collect()[0].asDict()
    elif method == "loglinear":
        found = loglinear.select(loglinear.table_of(cells(histories, arms), len(arms)), len(arms)).collect()[0].asDict()
    else:
        raise ValueError(f"no estimator {method!r}")
    return {"method": method} | found
