"""Flow-diagram counts and status rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(works: DataFrame, decisions: DataFrame, merges: DataFrame, ineligible: DataFrame) -> DataFrame:
    """One row: identified (not seeds), duplicates, ineligible, screened, included, excluded.

    works (key, directions array), merges (members), ineligible (n).
    """
    seeds = F.array_contains("directions", "seed")
    w = works.agg(F.count_if(~seeds).alias("identified"), F.count_if(seeds).alias("seeds"))
    d = decisions.join(works.where(~seeds), "key", "left_semi").agg(F.count_if(F.col("decision").isin("include", "exclude")).alias("screened"), F.count_if(F.col("decision") == "include").alias("included"), F.count_if(F.col("decision") == "exclude").alias("excluded"))
    m = merges.agg(F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).cast("long").alias("duplicates"))
    i = ineligible.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("ineligible"))
    return w.join(m).join(i).join(d)


def by_membership(provenance: DataFrame, column: str) -> DataFrame:
    """(value, n): works that any of their provenance gives to a provider or direction; a work may count more than once."""
    return provenance.select("key", F.col(column).alias("value")).distinct().groupBy("value").agg(F.count("*").alias("n"))


def status(works: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision, n), works without decision as unscreened."""
    return works.select("key").join(decisions, "key", "left").groupBy(F.coalesce("decision", F.lit("unscreened")).alias("decision")).agg(F.count("*").alias("n"))
