"""Simulated reviews with a known answer: seeds, recall curves, outcomes of stopping rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import expand


def select_seeds(gold: DataFrame, strategy: str, size: int, seed: int = 0, pool: DataFrame | None = None) -> DataFrame:
    """Keys of ``size`` gold works (key, cited_by, year), in order of keys.

    random goes by a hash of key and seed, so that every engine draws the same; most_cited counts unknown as 0, oldest
    unknown as 9999. boolean takes gold works that a search found, in the order of pool (key, place); where it found
    none or there is no pool, the first gold works.
    """
    if strategy == "boolean":
        if pool is None:
            return select_seeds(gold, "first", size)
        hits = pool.groupBy("key").agg(F.min("place").alias("place"))
        ranked = gold.join(hits, "key", "left").orderBy(F.col("place").asc_nulls_last(), "key").limit(size).select("key", "place")
        # unfound works only fill up where there is no hit at all
        some = ranked.agg(F.count("place").alias("hits"))
        return ranked.join(F.broadcast(some)).where("place is not null or hits = 0").select("key").orderBy("key")
    order = {
        "most_cited": [F.coalesce("cited_by", F.lit(0)).desc(), F.col("key")],
        "oldest": [F.coalesce("year", F.lit(9999)), F.col("key")],
        "random": [F.md5(F.concat_ws("|", F.lit(str(seed)), "key")), F.col("key")],
        "first": [F.col("key")],
    }
    if strategy not in order:
        raise ValueError(f"no seed strategy {strategy!r}")
    return gold.orderBy(*order[strategy]).limit(size).select("key").orderBy("key")


def trials(gold: DataFrame, strategies: list[str], sizes: list[int], repeats: int = 1) -> DataFrame:
    """(trial, key): seeds of the whole design; only random is repeated. trial: strategy/size/repeat."""
    out = None
    for strategy in strategies:
        for size in sizes:
            for r in range(repeats if strategy == "random" else 1):
                one = select_seeds(gold, strategy, size, r).select(F.lit(f"{strategy}/{size}/{r}").alias("trial"), "key")
                out = one if out is None else out.union(one)
    return out


def benchmark(edges: DataFrame, gold: DataFrame, strategies: list[str], sizes: list[int], repeats: int = 1, max_rounds: int = 100) -> DataFrame:
    """The history of every trial, all in one crawl."""
    found = expand.snowball(edges, trials(gold, strategies, sizes, repeats), gold, max_rounds)
    return expand.history(found)


def recall_curve(history: DataFrame, n_gold: int) -> DataFrame:
    """history with ``recall``: cumulative includes over the gold works, at most 1."""
    return history.withColumn("recall", F.least(F.lit(1.0), F.col("cumulative_included") / F.lit(float(max(1, n_gold)))))


def burden(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(trial, target, screened): records screened when recall first reaches the target, null if never."""
    each = curve.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    return each.groupBy("trial", "target").agg(F.min(F.when(F.col("recall") >= F.col("target"), F.col("cumulative_screened"))).alias("screened"))


def outcomes(curve: DataFrame, fired: DataFrame, n_gold: int, target: float = 0.95) -> DataFrame:
    """Each rule against the best stop: the first round that reaches the target, or the last one."""
    best = curve.groupBy("trial").agg(F.coalesce(F.min(F.when(F.col("recall") >= target, F.col("n"))), F.max("n")).alias("optimal_n"))
    at = curve.select("trial", "n", "recall", "cumulative_screened")
    opt = best.join(at.withColumnsRenamed({"n": "optimal_n", "cumulative_screened": "optimal_screened"}).drop("recall"), ["trial", "optimal_n"])
    stop = at.withColumnsRenamed({"n": "fired_at", "recall": "recall_at_stop", "cumulative_screened": "screened_at_stop"})
    rows = fired.join(stop, ["trial", "fired_at"], "left").join(opt, "trial")
    missed = F.when(F.col("recall_at_stop").isNotNull(), F.greatest(F.lit(0), F.bround((F.lit(target) - F.col("recall_at_stop")) * n_gold).cast("long")))
    rows = rows.withColumn("missed", missed).withColumn("excess", F.col("screened_at_stop") - F.col("optimal_screened"))
    regret = F.when(F.col("excess") > 0, F.col("excess") / F.greatest(F.lit(1), F.col("optimal_screened"))).otherwise(F.col("missed") / F.lit(float(max(1, n_gold))))
    return rows.select("trial", "rule", "fired_at", "optimal_n", "recall_at_stop", (F.col("fired_at") - F.col("optimal_n")).alias("overshoot"), "excess", "missed", regret.alias("regret"))


def calibration(pairs: DataFrame) -> DataFrame:
    """bias, mae, rmse, overestimate_rate from rows (estimated, true)."""
    d = F.col("estimated") - F.col("true")
    return pairs.where("estimated is not null and true is not null").agg(F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg((d > 0).cast("double")).alias("overestimate_rate"), F.count("*").alias("n"))


def synthetic_graph(spark: SparkSession, relevant: int = 120, irrelevant: int = 900, first_year: int = 2005, years: int = 20, in_rate: float = 0.06, out_rate: float = 0.004, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """works, edges and gold of a random citation graph without cycles.

    Work i cites an earlier work j with a chance that is higher if both are relevant. Instead of trying all pairs, each
    work draws, for each kind, a number of references by hash and their targets among the earlier works, so that the
    cost grows with the edges.
    """
    total = relevant + irrelevant
    u = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / float(1 << 30)
    works = spark.range(total).select(
        F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("key"),
        F.col("id").alias("place"),
        (u(F.lit("kind"), "id") < relevant / total).alias("relevant"),
        (F.lit(first_year) + F.floor(F.col("id") * years / total)).cast("int").alias("year"),
    )
    numbered = works.withColumn("k", F.row_number().over(Window.partitionBy("relevant").orderBy("place")) - 1)
    drawn = numbered.withColumn("to_relevant", F.explode(F.array(F.lit(True), F.lit(False))))
    earlier = F.when(F.col("to_relevant") == F.col("relevant"), F.col("k")).otherwise(F.col("place") - F.col("k"))
    rate = F.when(F.col("relevant") & F.col("to_relevant"), F.lit(in_rate)).otherwise(F.lit(out_rate))
    n = F.floor(earlier * rate + u(F.lit("n"), "place", "to_relevant")).cast("int")
    refs = drawn.withColumn("earlier", earlier).withColumn("n", n).where("n > 0").withColumn("r", F.explode(F.sequence(F.lit(1), F.col("n"))))
    refs = refs.select(F.col("key").alias("src"), F.col("to_relevant").alias("relevant"), F.floor(u(F.lit("to"), "place", "to_relevant", "r") * F.col("earlier")).cast("long").alias("k"), F.col("r"), F.col("place").alias("src_place"))
    target = numbered.select("relevant", F.col("k").cast("long").alias("k"), F.col("key").alias("dst"))
    provider = F.when(u(F.lit("provider"), "src_place", "r") < 0.5, "a").otherwise("b")
    edges = refs.join(target, ["relevant", "k"]).select("src", "dst", F.lit("backward").alias("direction"), provider.alias("provider")).distinct()
    return works.drop("place"), edges, works.where("relevant").select("key")
