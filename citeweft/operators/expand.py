"""Graph expansion: one frontier step, and the crawl to saturation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Bucketed, durable, durable_counted


def neighbours(edges: DataFrame, frontier: DataFrame, works: DataFrame | None = None, directions: tuple[str, ...] | None = None) -> DataFrame:
    """(trial, parent, key, provider, direction) from edges (src, dst, provider, direction) and a frontier (trial, key).

    Spark broadcasts the frontier while it is small and shuffles on the parent otherwise. ``works``: keys that are
    known; others are dropped.
    """
    e = edges if directions is None else edges.where(F.col("direction").isin(*directions))
    out = e.join(frontier.withColumnRenamed("key", "src"), "src").select("trial", F.col("src").alias("parent"), F.col("dst").alias("key"), "provider", "direction").distinct()
    return out if works is None else out.join(works.select("key"), "key", "left_semi")


def snowball(edges: DataFrame, seeds: DataFrame, included: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(trial, key, n, included): when each key was first found; seeds have n 0.

    edges (src, dst), seeds (trial, key), included (key): what the screener takes. The frontier is the round's new
    includes; all trials go through one crawl, and a trial is over when its frontier is empty. Edges lie in buckets by src,
    with whether dst would be included: a round reads them where they lie.
    """
    gold = included.select(F.col("key").alias("dst")).distinct().withColumn("included", F.lit(True))
    step = Bucketed(edges.select("src", "dst").distinct().join(gold, "dst", "left").select("src", "dst", F.coalesce("included", F.lit(False)).alias("included")), "src")
    links = step.read()
    found = durable(seeds.select("trial", "key").distinct().select("trial", "key", F.lit(0).alias("n"), F.lit(True).alias("included")))
    frontier = found
    for n in range(1, max_rounds + 1):
        new, count = durable_counted(one_round(links, frontier, found, n))
        if not count:
            break
        found = durable(found.union(new)) if n % 8 == 0 else found.union(new)
        frontier = new
    step.close()
    return found


def one_round(step: DataFrame, last: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """What round n finds: step (src, dst, included) in buckets by src, last (trial, key, included) of the round before."""
    frontier = last.where("included").select("trial", F.col("key").alias("src"))
    near = step.join(frontier, "src").groupBy("trial", F.col("dst").alias("key")).agg(F.first("included").alias("included"))
    return near.join(found.select("trial", "key"), ["trial", "key"], "left_anti").select("trial", "key", F.lit(n).alias("n"), "included")


def history(found: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Per trial and round: n_screened, n_included, both cumulated (seeds count as included), frontier_size, yield_rate."""
    from pyspark.sql import Window

    rounds = found.where("n > 0").groupBy("trial", "n").agg(F.count("*").alias("n_screened"), F.count_if("included").alias("n_included"))
    seeds = found.where("n = 0").groupBy("trial").agg(F.count("*").alias("n_seeds"))
    w = Window.partitionBy("trial").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rounds.join(seeds, "trial")
    return rows.select(
        "trial",
        "n",
        "n_screened",
        "n_included",
        F.sum("n_screened").over(w).alias("cumulative_screened"),
        (F.sum("n_included").over(w) + F.col("n_seeds")).alias("cumulative_included"),
        F.col("n_included").alias("frontier_size"),
        F.coalesce(F.try_divide("n_included", "n_screened"), F.lit(0.0)).alias("yield_rate"),
    )


def enqueue(keys: DataFrame, expanded: DataFrame, frontier: DataFrame) -> DataFrame:
    """The frontier with new keys: those neither expanded nor waiting."""
    return frontier.select("key").union(keys.select("key").join(expanded, "key", "left_anti")).distinct()


def provenance(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(trial, key, provider, direction, parent, n) for every way in which a key was found."""
    parents = found.where("included").select("trial", F.col("key").alias("src"), (F.col("n") + 1).alias("n"))
    ways = edges.join(parents, "src").select("trial", F.col("dst").alias("key"), "provider", "direction", F.col("src").alias("parent"), "n").distinct()
    return ways.join(found.select("trial", "key"), ["trial", "key"], "left_semi")
