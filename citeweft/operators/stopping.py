"""Stopping rules over the history of rounds; each gives a row for every round, with its reason in words."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DECISION = ("trial", "n", "rule", "triggered", "value", "threshold", "rationale", "advisory")


def _decide(rows: DataFrame, rule: str, triggered, value, threshold: float, rationale, advisory: bool = False) -> DataFrame:
    return rows.select("trial", "n", F.lit(rule).alias("rule"), F.coalesce(triggered, F.lit(False)).alias("triggered"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), rationale.alias("rationale"), F.lit(advisory).alias("advisory"))


def _by_round() -> Window:
    return Window.partitionBy("trial").orderBy("n")


def marginal_yield(history: DataFrame, eps: float = 0.01, k: int = 2) -> DataFrame:
    """Fires when the last k rounds all yielded less than ``eps``; needs k rounds."""
    last = _by_round().rowsBetween(1 - k, 0)
    rows = history.withColumn("worst", F.max("yield_rate").over(last)).withColumn("have", F.count("*").over(last))
    fired = (F.col("have") >= k) & (F.col("worst") < eps)
    said = F.when(F.col("have") < k, F.format_string(f"There are not yet {k} rounds.")).otherwise(F.format_string(f"Yield of the last {k} iterations is at most %.4f; the limit is {eps:.4f}.", F.col("worst")))
    return _decide(rows, "marginal_yield", fired, F.col("yield_rate"), eps, said)


def budget(history: DataFrame, max_screened: int, min_yield_per_100: float | None = None) -> DataFrame:
    """Fires at so many screened records, or below so many includes in a hundred."""
    spent = F.col("cumulative_screened") >= max_screened
    low = F.lit(False) if min_yield_per_100 is None else F.col("yield_rate") * 100 < min_yield_per_100
    said = F.format_string(f"%d of {max_screened} records screened.", F.col("cumulative_screened"))
    return _decide(history, "budget", spent | low, F.col("cumulative_screened"), max_screened, said)


def exhaustion(history: DataFrame) -> DataFrame:
    """Fires when nothing is left to expand."""
    said = F.when(F.col("frontier_size") == 0, F.lit("No record is left to expand.")).otherwise(F.format_string("%d records are left to expand.", F.col("frontier_size")))
    return _decide(history, "exhaustion", F.col("frontier_size") == 0, F.col("frontier_size"), 0, said)


def recall_stability(trail: DataFrame, tau: float = 0.95, use_lower: bool = True, min_stable: int = 2, max_drift: float = 0.05, authoritative: bool = False) -> DataFrame:
    """Estimated recall at ``tau`` or more while the population estimate stands still.

    trail (trial, n, estimable, n_hat, recall, recall_low). Drift is the largest relative change over the last
    ``min_stable`` steps between estimable rounds. Advisory unless authoritative.
    """
    good = trail.where("estimable and n_hat > 0")
    w = _by_round()
    step = F.abs(F.col("n_hat") - F.lag("n_hat").over(w)) / F.lag("n_hat").over(w)
    good = good.withColumn("step", step).withColumn("drift", F.max("step").over(w.rowsBetween(1 - min_stable, 0))).withColumn("points", F.row_number().over(w))
    rows = trail.join(good.select("trial", "n", "drift", "points"), ["trial", "n"], "left")
    value = F.coalesce("recall_low", "recall") if use_lower else F.col("recall")
    stable = (F.col("points") > min_stable) & (F.col("drift") <= max_drift)
    if min_stable <= 0:
        stable = F.lit(True)
    said = F.when(~F.col("estimable"), F.lit("No estimate.")).when(~F.coalesce(stable, F.lit(False)), F.lit("The estimated population is still moving.")).otherwise(F.format_string(f"Estimated recall is %.4f; the target is {tau:.4f}.", value))
    return _decide(rows, "estimated_recall", (value >= tau) & stable & F.col("estimable"), value, tau, said, not authoritative)


def fit_asymptote(x: list[float], y: list[float]) -> tuple[float, float]:
    """Least squares for y = N (1 - exp(-rate x)), N at least the last y, rate from 1e-4 to 10.

    For a given rate the best N is in closed form, so one search over the rate is enough: a grid, then golden sections.
    """
    a, b = np.asarray(x, float), np.asarray(y, float)
    least = b[-1]

    def at(log_rate: float) -> tuple[float, float]:
        g = 1 - np.exp(-math.exp(log_rate) * a)
        n = max(least, float(g @ b / (g @ g)))
        return float(((b - n * g) ** 2).sum()), n

    grid = np.linspace(math.log(1e-4), math.log(10), 400)
    k = int(np.argmin([at(r)[0] for r in grid]))
    lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        if at(c)[0] < at(d)[0]:
            hi = d
        else:
            lo = c
    rate = (lo + hi) / 2
    return at(rate)[1], math.exp(rate)


def asymptotic_coverage(history: DataFrame, tau: float = 0.95, min_points: int = 4) -> DataFrame:
    """Coverage of the asymptote fitted to cumulative includes up to each round.

    One trial's rounds (few, by the run's limit) are fitted in a grouped pandas function, all trials in parallel.
    """
    ddl = "trial string, n int, rule string, triggered boolean, value double, threshold double, rationale string, advisory boolean"

    def fit(rows):
        import pandas as pd

        rows = rows.sort_values("n")
        out = []
        for k in range(1, len(rows) + 1):
            part = rows.iloc[:k]
            value, said = None, f"No curve is fitted to under {min_points} rounds."
            if k >= min_points and part["cumulative_included"].iloc[-1] > 0:
                top, _ = fit_asymptote(part["n"].tolist(), part["cumulative_included"].tolist())
                value = float(part["cumulative_included"].iloc[-1] / top)
                said = f"{value:.4f} of the fitted asymptote {top:.1f}; the target is {tau:.4f}."
            out.append((part["trial"].iloc[-1], int(part["n"].iloc[-1]), "asymptotic_coverage", value is not None and value >= tau, value, tau, said, False))
        return pd.DataFrame(out, columns=list(DECISION))

    slim = history.select(F.col("trial").cast("string").alias("trial"), "n", "cumulative_included")
    return slim.groupBy("trial").applyInPandas(fit, ddl)


def first_fired(decisions: DataFrame) -> DataFrame:
    """(trial, rule, fired_at): each rule's first round, null if it never fired."""
    return decisions.groupBy("trial", "rule").agg(F.min(F.when(F.col("triggered"), F.col("n"))).alias("fired_at"))


def rule_set(decisions: DataFrame, order: list[str], combine: str = "any_of") -> DataFrame:
    """(trial, n, stop, stopped_by) by round.

    Advisory rules never stop a run, exhaustion always does. ``all_of`` asks for all the others; stopped_by is the first
    firing rule in the order of the settings.
    """
    place = F.coalesce(F.try_element_at(F.create_map(*(x for k, r in enumerate(order) for x in (F.lit(r), F.lit(k)))), "rule"), F.lit(len(order)))
    counts = ~F.col("advisory") & (F.col("rule") != "exhaustion")
    over = F.max(F.when(F.col("rule") == "exhaustion", F.col("triggered").cast("int")))
    if combine == "any_of":
        rest = F.max(F.when(counts, F.col("triggered").cast("int")))
    else:
        rest = F.min(F.when(counts, F.col("triggered").cast("int")))
    name = F.min_by("rule", F.when(F.col("triggered") & ~F.col("advisory"), place))
    rows = decisions.groupBy("trial", "n").agg(F.greatest(F.coalesce(over, F.lit(0)), F.coalesce(rest, F.lit(0))).alias("s"), name.alias("name"))
    return rows.select("trial", "n", (F.col("s") == 1).alias("stop"), F.when(F.col("s") == 1, F.col("name")).alias("stopped_by"))


# --- rules by name -------------------------------------------------------------------------------------------------

#: A rule is made from the history, the trail of estimates, and the options of the settings.
Make = Callable[..., DataFrame]
RULES: dict[str, Make] = {
    "marginal_yield": lambda history, trail, **k: marginal_yield(history, **k),
    "budget": lambda history, trail, **k: budget(history, **k),
    "exhaustion": lambda history, trail, **k: exhaustion(history, **k),
    "estimated_recall": lambda history, trail, **k: recall_stability(trail, **k),
    "asymptotic_coverage": lambda history, trail, **k: asymptotic_coverage(history, **k),
}
OWN = frozenset(RULES)


class RuleError(ValueError):
    """A rule that does not keep to what a rule has to give."""


def register(name: str, make: Make) -> None:
    """Adds a rule under a name that settings can ask for: make(history, trail, **options) gives a DataFrame of decisions.

    Decisions have the columns of ``DECISION``, and one row for each trial and round of the history. The library's own rules
    cannot be replaced; a name that was registered before can.
    """
    if not name or name in OWN:
        raise RuleError(f"{name!r} is a rule of the library's own" if name else "a rule needs a name")
    RULES[name] = make


def window_rule(name: str, measure: Callable[[WindowSpec], Column], fires: Callable[[Column], Column], threshold: float, rounds: int | None = None, least: int = 1, advisory: bool = False) -> Make:
    """A rule from an aggregate over each trial's last rounds, all of them if ``rounds`` is None.

    measure: a window to a column, so any aggregate there is, a pandas function of groups too; fires: the measure to a
    condition. With fewer than ``least`` rounds the rule has no value and does not fire.
    """

    def make(history: DataFrame, trail: DataFrame | None = None, threshold: float = threshold) -> DataFrame:
        w = _by_round().rowsBetween(Window.unboundedPreceding if rounds is None else 1 - rounds, 0)
        rows = history.withColumn("_value", measure(w).cast("double")).withColumn("_have", F.count("*").over(w))
        rows = rows.withColumn("_value", F.when(F.col("_have") >= least, F.col("_value")))
        said = F.when(F.col("_value").isNull(), F.lit(f"{name} has no value yet.")).otherwise(F.format_string(f"{name} is %.4f; the limit is {threshold:.4f}.", F.col("_value")))
        return _decide(rows, name, fires(F.col("_value")), F.col("_value"), threshold, said, advisory)

    return make


def checked(name: str, decisions: DataFrame, history: DataFrame) -> DataFrame:
    """The decisions of a registered rule, if they are what a rule has to give; rounds are few, so they are looked at."""
    kinds = {"rule": "string", "triggered": "boolean", "value": "double", "threshold": "double", "rationale": "string", "advisory": "boolean"}
    found = dict(decisions.dtypes)
    wrong = [c for c in DECISION if c not in found or found[c] != kinds.get(c, found[c])]
    if wrong:
        raise RuleError(f"rule {name!r}: columns {', '.join(wrong)} are missing or of another type")
    rows = decisions.select(*DECISION)
    each = rows.groupBy("trial", "n").agg(F.count("*").alias("k"), F.bool_and(F.col("triggered").isNotNull() & (F.col("rule") == name)).alias("ok"))
    odd = history.select("trial", "n").distinct().withColumn("there", F.lit(True)).join(each, ["trial", "n"], "full_outer").where("there is null or k is null or k <> 1 or not ok").limit(1).collect()
    if odd:
        raise RuleError(f"rule {name!r}: not one decision of its own in trial {odd[0].trial}, round {odd[0].n}")
    return rows


def evaluate(history: DataFrame, trail: DataFrame | None, rules: dict[str, dict]) -> DataFrame:
    """The decisions of the named rules, with their options, for all rounds of all trials."""
    out = None
    for name, options in rules.items():
        if name not in RULES:
            raise RuleError(f"no rule {name!r}; there are {', '.join(sorted(RULES))}")
        one = RULES[name](history, trail, **options)
        if name not in OWN:
            one = checked(name, one, history)
        out = one.select(*DECISION) if out is None else out.union(one.select(*DECISION))
    if out is None:
        raise RuleError("there are no rules")
    return out
