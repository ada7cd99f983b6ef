"""Ranking of candidates: scores (key, score) only; no ranker decides anything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import RankWeights
from ..storage import Bucketed, durable


def term_counts(docs: DataFrame) -> DataFrame:
    """(key, term, tf) from rows (key, terms)."""
    return docs.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def bm25(included: DataFrame, candidates: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Candidates (key, terms) scored by the terms of all included ones; statistics are the candidates'.

    Terms are summed in their order, so that a score does not hang on how the rows were spread.
    """
    # texts are taken apart once; counts lie in buckets by term, where they meet those of the query
    tf = Bucketed(term_counts(candidates), "term").read()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    query = included.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("qw"))
    sizes = durable(candidates.select("key", F.size("terms").alias("dl")))
    whole = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    rows = tf.join(query.join(df, "term"), "term").join(sizes, "key").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.log(1 + F.col("qw"))
    sums = rows.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("term", part.alias("x")))), F.lit(0.0), lambda acc, y: acc + y["x"]).alias("score"))
    return sizes.select("key").join(sums, "key", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score"))


def network_features(provenance: DataFrame, candidates: DataFrame, included: DataFrame) -> DataFrame:
    """(key, n_parents, cocitation, coupling, both_directions) from provenance (key, parent, direction).

    n_parents: included works that it was found through. cocitation: for each included work, the parents both have.
    coupling is the same count as n_parents: an included work's references are known by its key alone.
    """
    inc = included.select("key").distinct()
    own = provenance.select("key", "parent").where("parent is not null").distinct().join(candidates.select("key"), "key", "left_semi")
    parents = own.join(inc.withColumnRenamed("key", "parent"), "parent", "left_semi").groupBy("key").agg(F.count("*").alias("n_parents"))
    # each parent's included works, less the candidate itself where it is one of them
    theirs = provenance.join(inc, "key", "left_semi").select("key", "parent").where("parent is not null").distinct().groupBy("parent").agg(F.count("*").alias("n"))
    sums = own.join(theirs, "parent").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("self"))
    shared = sums.join(inc.withColumn("in", F.lit(True)), "key", "left").select("key", (F.col("n") - F.when(F.col("in"), F.col("self")).otherwise(0)).alias("cocitation"))
    ways = provenance.groupBy("key").agg((F.countDistinct(F.when(F.col("direction").isin("backward", "forward"), F.col("direction"))) == 2).cast("int").alias("both_directions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = candidates.select("key").join(parents, "key", "left").join(shared, "key", "left").join(ways, "key", "left")
    return rows.select("key", zero("n_parents"), zero("cocitation"), zero("n_parents").alias("coupling"), zero("both_directions"))


def network_score(features: DataFrame, weights: RankWeights = RankWeights()) -> DataFrame:  # noqa: B008
    """The weighted sum of the scaled features; ranges come from one aggregate row, not from a window over all."""
    names = ("n_parents", "cocitation", "coupling")
    ends = features.agg(*(f(c).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))))
    rows = features.join(F.broadcast(ends))
    scale = lambda c: F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") < 1e-12, F.lit(0.0)).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    total = weights.parents * scale("n_parents") + weights.cocitation * scale("cocitation") + weights.coupling * scale("coupling") + weights.direction * F.col("both_directions")
    return rows.select("key", total.alias("score"))


def centroid_score(vectors: DataFrame, included: DataFrame) -> DataFrame:
    """(key, score): cosine with the mean of the included unit vectors. vectors (key, v)."""
    unit = vectors.select("key", F.expr("transform(v, x -> cast(x as double))").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = unit.withColumn("norm", norm).select("key", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("v"))
    dims = unit.join(included.select("key"), "key", "left_semi").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    centre = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x * x))
    dot = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return unit.join(F.broadcast(centre)).select("key", F.coalesce(F.try_divide(dot, length), F.lit(0.0)).alias("score"))


def null_score(candidates: DataFrame) -> DataFrame:
    return candidates.select("key", F.lit(0.0).alias("score"))


def positions(scores: DataFrame) -> DataFrame:
    """Ranks from 1 by falling score, then key. Scores are compared to 8 places, whatever the order of summing.

    Rows are dealt out by ranges and numbered within each; the few sizes of the ranges give where each begins.
    """
    order = [F.round("score", 8).desc(), F.col("key").asc()]
    dealt = durable(scores.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = dealt.withColumn("rank", inside).join(F.broadcast(sizes), "_part")
    return ranked.withColumn("rank", (F.col("rank") + F.col("_before")).cast("int")).select(*scores.columns, "rank")


def fuse(rankings: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of named scores; a key missing from a ranking stands behind its last."""
    keys = None
    for scores in rankings.values():
        keys = scores.select("key") if keys is None else keys.union(scores.select("key"))
    rows = keys.distinct()
    total = F.lit(0.0)
    for name in sorted(rankings):
        ranked = positions(rankings[name]).select("key", F.col("rank").alias(f"r_{name}"))
        n = rankings[name].agg(F.count("*").alias(f"n_{name}"))
        rows = rows.join(ranked, "key", "left").join(F.broadcast(n))
        total = total + 1.0 / (k + F.coalesce(f"r_{name}", F.col(f"n_{name}") + 1))
    return rows.select("key", total.alias("score"))


def top(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Candidates in order (rank, key, score), the first k."""
    if k is None:
        return positions(scores)
    order = [F.round("score", 8).desc(), F.col("key").asc()]
    return scores.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


#: A ranker is f(included, candidates, provenance, vectors) -> (key, score).
Ranker = Callable[[DataFrame, DataFrame, DataFrame, DataFrame | None], DataFrame]
RANKERS: dict[str, Ranker] = {
    "none": lambda inc, cand, prov, vec: null_score(cand),
    "bm25": lambda inc, cand, prov, vec: bm25(inc, cand),
    "network": lambda inc, cand, prov, vec: network_score(network_features(prov, cand, inc)),
    "embedding": lambda inc, cand, prov, vec: centroid_score(vec, inc).join(cand.select("key"), "key", "left_semi"),
    "fusion": lambda inc, cand, prov, vec: fuse({"bm25": bm25(inc, cand), "network": network_score(network_features(prov, cand, inc))}),
}
OWN = frozenset(RANKERS)


class RankerError(ValueError):
    """A ranker that is not there, or does not give a score for each candidate."""


def register(name: str, ranker: Ranker) -> None:
    """Adds a ranker under a name that settings can ask for; the library's own cannot be replaced."""
    if not name or name in OWN:
        raise RankerError(f"{name!r} is a ranker of the library's own" if name else "a ranker needs a name")
    RANKERS[name] = ranker


def _checked(name: str, ranker: Ranker) -> Ranker:
    """A registered ranker's scores, of candidates alone and of each one: those it leaves out, or scores null or NaN, get 0."""

    def run(inc: DataFrame, cand: DataFrame, prov: DataFrame, vec: DataFrame | None) -> DataFrame:
        got = ranker(inc, cand, prov, vec)
        lost = [c for c in ("key", "score") if c not in got.columns]
        if lost:
            raise RankerError(f"ranker {name!r} gives no {' and no '.join(lost)}")
        best = got.groupBy("key").agg(F.max(F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double"))).alias("score"))
        return cand.select("key").distinct().join(best, "key", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score"))

    return run


def build(name: str) -> Ranker:
    """A ranker by its name."""
    if name not in RANKERS:
        raise RankerError(f"no ranker {name!r}; there are {', '.join(sorted(RANKERS))}")
    return RANKERS[name] if name in OWN else _checked(name, RANKERS[name])
