"""Log-linear capture models of many tables at once, by iterative proportional fitting.

A table has a count for each pattern of captures but the empty one. A model has main effects and some pairs of arms; its
fitted cells keep the table's sums over every pair it has, and over every arm in no pair of it. Fitting starts from ones and
sets each of these sums right in turn, round after round, until cells stand still (or ``ROUNDS`` is reached); starting
from the counts themselves fits the model that has a term for each cell. Sums that are 0 are taken as ``TINY``, so that
ratios of fitted cells stay defined.

Every table meets every model in a row of its own, with its cells as an array (their number is bounded by the arms), and
the fit is an expression over that array: all models of all tables are fitted in one pass, without a shuffle for a round.
No pairwise model has a term of three arms, so the empty pattern's cell follows from the seven of any three arms.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS, TINY = 300, 1e-8


def masks(k: int, terms: tuple[tuple[int, int], ...]) -> list[int]:
    """The sums that a model keeps, as the bits of the patterns they go by; arm 0 is the highest bit."""
    bit = lambda i: 1 << (k - 1 - i)
    inside = {i for t in terms for i in t}
    return [bit(i) | bit(j) for i, j in terms] + [bit(i) for i in range(k) if i not in inside]


def models(spark: SparkSession, k: int) -> DataFrame:
    """(model, terms, params, masks): every set of pairs that leaves no more parameters than cells, small sets first."""
    pairs, rows = list(combinations(range(k), 2)), []
    for size in range(len(pairs) + 1):
        for terms in combinations(pairs, size):
            if 1 + k + size <= (1 << k) - 1:
                rows.append((len(rows), ",".join(f"{i}:{j}" for i, j in terms), 1 + k + size, masks(k, terms)))
    return spark.createDataFrame(rows, "model int, terms string, params int, masks array<int>")


def _sums(cells: Column, mask: Column, size: int) -> Column:
    """For each cell the sum of those with the same bits under the mask."""
    at = F.sequence(F.lit(1), F.lit(size))
    return F.transform(at, lambda p: F.aggregate(at, F.lit(0.0), lambda s, q: s + F.when(q.bitwiseAND(mask) == p.bitwiseAND(mask), F.get(cells, q - 1)).otherwise(0.0)))


def _log_factorial(y: Column) -> Column:
    """By Stirling's series, from 16 on."""
    stirling = (y + 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y)
    return F.when(y < 16, F.log(F.factorial(y.cast("int")).cast("double"))).otherwise(stirling)


def fits(tables: DataFrame, k: int) -> DataFrame:
    """The rows of tables (y: an array of doubles, by rising pattern) for each model, with cells, unseen and aic."""
    size = (1 << k) - 1
    spark = tables.sparkSession
    both = tables.crossJoin(F.broadcast(models(spark, k)))  # models are few, by the arms alone
    both = both.withColumn("kept", F.transform("masks", lambda g: F.transform(_sums(F.col("y"), g, size), lambda s: F.greatest(s, F.lit(TINY)))))
    full = F.col("params") == size
    start = F.when(full, F.transform("y", lambda y: F.greatest(y, F.lit(TINY)))).otherwise(F.array_repeat(F.lit(1.0), size))
    each = F.arrays_zip("masks", "kept")

    def set_right(cells: Column, x: Column) -> Column:
        return F.zip_with(F.zip_with(cells, x["kept"], lambda m, t: m * t), _sums(cells, x["masks"], size), lambda m, s: m / s)

    def around(state: Column, _: Column) -> Column:
        new = F.transform(F.array(F.aggregate(each, state["cells"], set_right)), lambda n: F.struct(n.alias("cells"), (F.array_max(F.zip_with(n, state["cells"], lambda a, b: F.abs(a - b) / a)) < 1e-12).alias("still")))
        return F.when(state["still"], state).otherwise(F.get(new, F.lit(0)))

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(start.alias("cells"), full.alias("still")), around)
    out = both.withColumn("cells", fitted["cells"])
    terms = F.zip_with("y", "cells", lambda y, m: F.when(y > 0, y * F.log(m)).otherwise(0.0) - m - _log_factorial(y))
    log_likelihood = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    cell = lambda *arms: F.log(F.get("cells", F.lit(sum(1 << (k - 1 - i) for i in arms) - 1)))
    if k > 2:
        unseen = cell(0) + cell(1) + cell(2) + cell(0, 1, 2) - cell(0, 1) - cell(0, 2) - cell(1, 2)
    else:
        unseen = cell(0) + cell(1) - cell(0, 1)
    return out.withColumn("unseen", F.exp(unseen)).withColumn("aic", 2 * F.col("params") - 2 * log_likelihood).drop("masks", "kept")


def select(tables: DataFrame, k: int, limit: float = 3.0) -> DataFrame:
    """The tables' rows with n_observed, estimable, reason, n_hat, recall, terms, aic of the model of least AIC.

    Refusals in order: no records, an empty arm, a chosen interaction with an empty cell of just some pair, and an estimate
    above ``limit`` times what was seen. Of models within 1e-8 of each other the one with fewer terms, then the first, is
    taken. No interval is given. A null count is 0; one arm has no estimate.
    """
    names = [c for c in tables.columns if c != "y"]
    counts = tables.withColumn("y", F.transform("y", lambda y: F.coalesce(y.cast("double"), F.lit(0.0))))
    size = (1 << k) - 1
    total = lambda mask: F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.lit(0.0), lambda s, q: s + F.when(q.bitwiseAND(F.lit(mask)) > 0, F.get("y", q - 1)).otherwise(0.0))
    one = fits(counts.withColumn("_row", F.monotonically_increasing_id()), k)
    best = F.min_by(F.struct("y", "terms", "unseen", "aic"), F.struct(F.round("aic", 8), "model"))
    got = one.groupBy("_row", *names).agg(best.alias("b")).select(*names, "b.*")
    got = got.withColumn("n_observed", F.aggregate("y", F.lit(0.0), lambda s, x: s + x).cast("bigint"))
    no_arm, no_pair = F.lit(False), F.lit(False)
    for i in range(k):
        no_arm = no_arm | (total(1 << (k - 1 - i)) == 0)
    for i, j in combinations(range(k), 2):
        no_pair = no_pair | (F.get("y", F.lit((1 << (k - 1 - i) | 1 << (k - 1 - j)) - 1)) == 0)
    n_hat = F.col("n_observed") + F.col("unseen")
    reason = (
        F.when(F.col("n_observed") == 0, "no_records")
        .when(F.lit(k < 2), "fewer_than_two_arms")
        .when(no_arm, "empty_arm")
        .when((F.col("terms") != "") & no_pair, "empty_pair_cell")
        .when(F.coalesce(~(n_hat <= limit * F.col("n_observed")), F.lit(True)), "implausible")
    )
    ok = F.col("reason").isNull()
    shown = F.col("n_observed") > 0
    got = got.withColumn("reason", reason)
    return got.select(*names, "n_observed", ok.alias("estimable"), "reason", F.when(ok, n_hat).alias("n_hat"), F.when(ok, F.col("n_observed") / n_hat).alias("recall"), F.when(shown, F.col("terms")).alias("terms"), F.when(shown, F.col("aic")).alias("aic"))


def table_of(cells: DataFrame, k: int, by: tuple[str, ...] = (), count: str = "n") -> DataFrame:
    """(by, y): one table for each group of cells (by, pattern, count); patterns that are missing count 0."""
    places = [F.sum(F.when(F.col("pattern") == format(p, f"0{k}b"), F.col(count))) for p in range(1, 1 << k)]
    return cells.groupBy(*by).agg(F.array(*(F.coalesce(p.cast("double"), F.lit(0.0)) for p in places)).alias("y"))
