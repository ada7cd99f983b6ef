"""Reproducibility: content hashes, integrity of the cache, and classes of drift between two snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.udfs import canonical_json, collect_ids
from ..storage import durable

TRACKED = ("title", "display_name", "doi", "DOI", "year", "publication_year", "type", "is_retracted")


def integrity(cache: DataFrame, *keep: str) -> DataFrame:
    """(cache_key, key_ok, body_ok and the columns to keep): whether an entry's name and body hash are what its content gives."""
    key = S.request_key(F.col("provider"), F.col("method"), canonical_json("params"))
    body = S.response_hash(canonical_json("body"))
    return cache.select("cache_key", *keep, (F.col("cache_key") == key).alias("key_ok"), (F.col("response_hash") == body).alias("body_ok"))


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(cache_key, provider, class, added, removed, changed_fields), the first that holds.

    old (cache_key, provider, response_hash, body), new (cache_key, http_status, body): deindexed (404 or nothing),
    unchanged (same hash), retracted, merged (another id), new_citing, lost_citing, new_citing (ids both ways),
    metadata_changed.
    """
    o = old.select("cache_key", "provider", "response_hash", F.col("body").alias("old_body"))
    n = new.select("cache_key", "http_status", F.col("body").alias("new_body"))
    both = o.join(n, "cache_key", "full_outer").where("provider is not null")
    both = both.withColumn("old_ids", collect_ids("old_body")).withColumn("new_ids", collect_ids("new_body")).withColumn("canonical", canonical_json("new_body"))
    field = lambda side, f: F.get_json_object(f"{side}_body", f"$.{f}")
    added, removed = F.array_sort(F.array_except("new_ids", "old_ids")), F.array_sort(F.array_except("old_ids", "new_ids"))
    rows = both.withColumn("added", added).withColumn("removed", removed)
    yes = lambda c: F.coalesce(c, F.lit("false")) == "true"
    more, less = F.size("added") > 0, F.size("removed") > 0
    kind = (
        F.when(F.coalesce(F.col("http_status") == 404, F.lit(False)) | F.col("new_body").isNull(), "deindexed")
        .when(S.response_hash(F.col("canonical")) == F.col("response_hash"), "unchanged")
        .when(~yes(field("old", "is_retracted")) & yes(field("new", "is_retracted")), "retracted")
        .when((field("old", "id") != "") & (field("new", "id") != "") & (field("old", "id") != field("new", "id")), "merged")
        .when(more & ~less, "new_citing")
        .when(less & ~more, "lost_citing")
        .when(more | less, "new_citing")
        .otherwise("metadata_changed")
    )
    changed = F.array_sort(F.array_compact(F.array(*(F.when(~field("old", f).eqNullSafe(field("new", f)), F.lit(f)) for f in TRACKED))))
    cited = F.col("class").isin("new_citing", "lost_citing")
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("class", kind)
    return rows.select("cache_key", "provider", "class", F.when(cited, F.col("added")).otherwise(none).alias("added"), F.when(cited, F.col("removed")).otherwise(none).alias("removed"), F.when(F.col("class") == "metadata_changed", changed).otherwise(none).alias("changed_fields"))


def drift_counts(diffs: DataFrame) -> DataFrame:
    """(provider, class, n), with totals under provider null."""
    return diffs.rollup("class", "provider").agg(F.count("*").alias("n")).where("class is not null").select("provider", "class", "n")


def ok(diffs: DataFrame) -> bool:
    """Whether nothing was deindexed."""
    return diffs.where("class = 'deindexed'").isEmpty()


class FetchError(ValueError):
    """A fetcher's answer that does not fit what it was asked for."""


def refresh(cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The drift of every cached request that is fetched anew, and one row of entries_checked, deindexed and ok.

    cache (cache_key, provider, method, params, response_hash, body). fetch: requests (cache_key, provider, method, params)
    to answers (cache_key, http_status, body), at most one for each; a request without an answer counts as gone. ``limit``
    takes the first requests in order of their keys. Nothing may be deindexed for ``ok``.
    """
    asked = cache if limit is None else cache.orderBy("cache_key").limit(limit)
    asked = durable(asked)
    got = fetch(asked.select(*(F.col(c) if c in asked.columns else F.lit(None).cast("string").alias(c) for c in ("cache_key", "provider", "method", "params"))))
    lost = [c for c in ("cache_key", "http_status", "body") if c not in got.columns]
    if lost:
        raise FetchError(f"answers have no {' and no '.join(lost)}")
    got = durable(got.select("cache_key", "http_status", "body"))
    odd = got.groupBy("cache_key").agg(F.count("*").alias("n")).join(asked.select("cache_key").withColumn("asked", F.lit(True)), "cache_key", "left").where("n > 1 or asked is null").limit(1).collect()
    if odd:
        raise FetchError(f"{odd[0].cache_key}: {'several answers' if odd[0].asked else 'not asked for'}")
    diffs = classify(asked, got)
    gone = F.count_if(F.col("class") == "deindexed")
    return diffs, diffs.agg(F.count("*").alias("entries_checked"), gone.alias("deindexed"), (gone == 0).alias("ok"))


# --- drift by summaries --------------------------------------------------------------------------------------------

#: Ranges that keys' hashes fall in; a snapshot that is written by ``snapshot`` has a folder for each.
RANGES = 256


def snapshot(rows: DataFrame, path: str, key: str = "cache_key", ranges: int = RANGES) -> DataFrame:
    """Writes a snapshot in folders by range of the key's hash, and beside it a summary; gives the summary (part, n, digest).

    The digest of a range is the XOR of a hash of each row, so that tasks fold what they have and the order does not count;
    with the number of rows, two ranges of equal summary hold the same rows but for a chance of 2**-64.
    """
    part = F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")
    dealt = rows.withColumn("part", part)
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/shape")  # the columns, where there is no row
    dealt.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    summary = written.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("digest"))
    summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")
    return summary_of(rows.sparkSession, path)


def summary_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, n long, digest long").parquet(f"{path}/summary")


def changed_ranges(old: DataFrame, new: DataFrame) -> list[int]:
    """The ranges whose summaries differ; at most ``RANGES`` rows are looked at."""
    both = old.toDF("part", "n", "digest").join(new.toDF("part", "m", "other"), "part", "full_outer")
    return sorted(r.part for r in both.where("not (n <=> m and digest <=> other)").select("part").collect())


def drift_between(spark: SparkSession, old: str, new: str, key: str = "cache_key") -> tuple[DataFrame, list[int]]:
    """What differs between two snapshots: (key, change, old, new) with the rows as structs, and the ranges that were read.

    change: added, removed or changed. Summaries are compared first; only folders of ranges that differ are read.
    """
    parts = changed_ranges(summary_of(spark, old), summary_of(spark, new))

    def side(path: str) -> DataFrame:
        shape = spark.read.parquet(f"{path}/shape").schema
        return spark.read.schema(shape.add("part", "integer")).parquet(f"{path}/rows").where(F.col("part").isin(parts)).drop("part")

    a, b = side(old), side(new)
    x = a.select(F.col(key), F.struct(*a.columns).alias("old"))
    y = b.select(F.col(key), F.struct(*b.columns).alias("new"))
    both = x.join(y, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.select(key, change.alias("change"), "old", "new"), parts


def closure_window(responses: DataFrame) -> DataFrame:
    """(provider, first_day, last_day, differs): when each provider was asked first and last. responses (provider, at).

    Responses without a time do not count; a provider that has none is left out.
    """
    day = F.date_format("at", "yyyy-MM-dd")
    return responses.where("at is not null").groupBy("provider").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), (F.min(day) != F.max(day)).alias("differs"))
