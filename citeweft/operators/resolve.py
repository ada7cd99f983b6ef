"""Entity resolution: blocking, match tiers, clusters, and the merge of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import DedupSettings
from ..storage import durable
from .graph import clusters
from .pairs import block_pairs, group_pairs
from .similar import lengths_allow, reached

RECORD = ("key", "title_norm", "year", "surname", "doi")


def blocks(records: DataFrame) -> DataFrame:
    """A record for each of its blocks."""
    return records.withColumn("block", F.explode(S.blocking_keys(F.col("title_norm"), F.col("year"))))


def doi_pairs(records: DataFrame) -> DataFrame:
    """T1 as stars: every record of a DOI with the smallest key of that DOI."""
    groups = records.where("doi <> ''").groupBy("doi").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1")
    return records.select("key", "doi").join(groups, "doi").where("key <> a").select("a", F.col("key").alias("b"), F.lit("T1").alias("tier"), F.lit(None).cast("double").alias("score"))


def candidate_pairs(records: DataFrame) -> DataFrame:
    """Pairs a < b that share a block, once each, with both records' fields; records without a title match nothing.

    For a look at the blocks: what no tier could take is among them. Matching goes by ``likely_pairs``.
    """
    return _once(block_pairs(blocks(records.select(*RECORD).where("title_norm <> ''")), "key", RECORD))


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.drop("block").dropDuplicates(["a_key", "b_key"])


def _could(a: str, b: str) -> Column:
    """What all tiers but T1 ask for, cheap enough for a join's condition."""
    c = lambda side, name: F.col(f"{side}_{name}")
    apart = F.coalesce((c(a, "doi") != "") & (c(b, "doi") != "") & (c(a, "doi") != c(b, "doi")), F.lit(False))
    near = S.year_close(c(a, "year"), c(b, "year")) & S.same_first_author(c(a, "surname"), c(b, "surname"))
    missing = (F.coalesce(c(a, "surname"), F.lit("")) == "") | (F.coalesce(c(b, "surname"), F.lit("")) == "")
    same = (c(a, "title_norm") == c(b, "title_norm")) & F.coalesce(c(a, "year") == c(b, "year"), F.lit(False)) & missing
    return ~apart & (F.coalesce(near, F.lit(False)) | F.coalesce(same, F.lit(False)))


def likely_pairs(records: DataFrame) -> DataFrame:
    """The candidate pairs that a tier could take; the others never leave the join, however large their block is.

    Years at most one apart share a block of their head, so that the head alone deals the pairs, each once.
    """
    rows = records.select(*RECORD).where("title_norm <> ''")
    return block_pairs(rows.withColumn("block", F.substring("title_norm", 1, 12)), "key", RECORD, _could("a", "b")).drop("block")


def tiered(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(a, b, tier, score): the first of T2, T3, T4 that holds; unlike DOIs and empty titles match nothing.

    The similarity is worked out for the pairs alone that need it and whose lengths, heads and letters allow it.
    """
    titles = (F.col("a_title_norm") != "") & (F.col("b_title_norm") != "")
    apart = F.coalesce((F.col("a_doi") != "") & (F.col("b_doi") != "") & (F.col("a_doi") != F.col("b_doi")), F.lit(False))
    same_title = F.col("a_title_norm") == F.col("b_title_norm")
    near = S.year_close(F.col("a_year"), F.col("b_year")) & S.same_first_author(F.col("a_surname"), F.col("b_surname"))
    missing = (F.coalesce("a_surname", F.lit("")) == "") | (F.coalesce("b_surname", F.lit("")) == "")
    t4 = same_title & F.coalesce(F.col("a_year") == F.col("b_year"), F.lit(False)) & missing
    open_ = pairs.where(titles & ~apart).withColumn("kind", F.when(same_title & near, "T2").when(near, "T3").when(t4, "T4")).where("kind is not null")
    need = F.col("kind") == "T3"
    open_ = open_.where(~need | lengths_allow(F.col("a_title_norm"), F.col("b_title_norm"), threshold))
    scored = open_.withColumn("score", reached(F.when(need, F.col("a_title_norm")), F.when(need, F.col("b_title_norm")), threshold))
    scored = scored.withColumn("score", F.when(need, F.col("score")).otherwise(F.lit(1.0)))
    return scored.where(~need | (F.col("score") >= threshold)).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), F.col("kind").alias("tier"), "score")


def groups(records: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """members (gid, key, doi, star) and alike (a, b, tier, score).

    Records of one title, year and surname are a group: a tier takes any two of them or none, but for unlike DOIs.
    ``alike`` has the groups whose records match, a group of several with itself among them. Copies are so compared once,
    and titles meet as groups, not as records. ``star`` is the smallest key of a record's DOI. Records without title or
    year are in no group: no tier but T1 takes them.
    """
    surname = F.coalesce("surname", F.lit(""))
    stars = records.where("doi <> ''").groupBy("doi").agg(F.min("key").alias("star"))
    rows = records.where("title_norm <> '' and year is not null and key is not null").join(stars, "doi", "left")
    named = rows.select("key", "title_norm", "year", surname.alias("surname"), F.nullif("doi", F.lit("")).alias("doi"), "star")
    named = durable(named.withColumn("gid", F.md5(F.concat_ws("\x1f", "title_norm", "year", "surname"))))
    each = named.groupBy("gid").agg(*(F.first(c).alias(c) for c in ("title_norm", "year", "surname")), F.count("*").alias("n"))
    each = durable(each.select(F.col("gid").alias("key"), "title_norm", "year", "surname", F.lit(None).cast("string").alias("doi"), "n"))
    own = each.where("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"), F.when(F.col("surname") != "", "T2").otherwise("T4").alias("tier"), F.lit(1.0).alias("score"))
    return named.select("gid", "key", "doi", "star"), durable(tiered(likely_pairs(each), threshold).union(own))


def expanded(members: DataFrame, alike: DataFrame) -> DataFrame:
    """(a, b, tier, score) for all records of groups that are alike, without unlike DOIs and the pairs of T1."""
    # DOIs are equal here where both are there, and those of a star are taken already
    both = F.col("p_doi").isNotNull() & F.col("q_doi").isNotNull()
    open_ = ~both | ((F.col("p_doi") == F.col("q_doi")) & (F.least("p_key", "q_key") != F.col("p_star")))
    met = group_pairs(members, alike, ("doi", "star"), open_)
    return met.select(F.least("p_key", "q_key").alias("a"), F.greatest("p_key", "q_key").alias("b"), "tier", "score")


def matches(records: DataFrame, settings: DedupSettings = DedupSettings(), tier: str | None = None) -> DataFrame:  # noqa: B008
    """All pairs (a, b, tier, score), or those of one tier; T1 comes before the others."""
    if tier == "T1":
        return doi_pairs(records)
    members, alike = groups(records, settings.jw_threshold)
    if tier:
        return expanded(members, alike.where(F.col("tier") == tier))
    return doi_pairs(records).union(expanded(members, alike))


def links(records: DataFrame, settings: DedupSettings = DedupSettings()) -> DataFrame:  # noqa: B008
    """(a, b, tier): some of the matches that leave the clusters of all of them, about as many as there are records.

    Records with a DOI match those of the same DOI, which T1 links, and those without one. So a group's records are linked
    to its smallest key without DOI, groups by these keys, and those of a group that has none to the other group's.
    """
    members, alike = groups(records, settings.jw_threshold)
    free = durable(members.where("doi is null").groupBy("gid").agg(F.min("key").alias("free")))
    side = lambda c: free.select(F.col("gid").alias(c), F.col("free").alias(f"{c}_free"))
    met = alike.join(side("a"), "a", "left").join(side("b"), "b", "left").where("a_free is not null or b_free is not null")
    heads = met.where("a <> b and a_free is not null and b_free is not null").select(F.col("a_free").alias("a"), F.col("b_free").alias("b"), "tier")
    rest = met.where("a = b or a_free is null or b_free is null").select(F.when(F.col("a_free").isNull(), F.col("a")).otherwise(F.col("b")).alias("gid"), F.coalesce("a_free", "b_free").alias("a"), "tier")
    rest = rest.join(members.select("gid", F.col("key").alias("b")), "gid").where("a <> b").select("a", "b", "tier")
    return doi_pairs(records).select("a", "b", "tier").union(heads).union(rest)


def labelled(records: DataFrame, settings: DedupSettings = DedupSettings()) -> DataFrame:  # noqa: B008
    """(key, rep, size, suspicious, cluster) for every record that matches another.

    Clusters above ``max_cluster_size`` are suspicious; their members stay apart: each is its own rep.
    """
    found = clusters(links(records, settings))
    sizes = found.groupBy("rep").agg(F.count("*").alias("size"))
    marked = found.join(sizes, "rep").withColumn("suspicious", F.col("size") > settings.max_cluster_size)
    return marked.select("key", F.when(F.col("suspicious"), F.col("key")).otherwise(F.col("rep")).alias("rep"), "size", "suspicious", F.col("rep").alias("cluster"))


def resolve(records: DataFrame, settings: DedupSettings = DedupSettings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``labelled`` and all matches."""
    return labelled(records, settings), matches(records, settings)


def matches_within(records: DataFrame, labels: DataFrame, settings: DedupSettings = DedupSettings()) -> DataFrame:  # noqa: B008
    """The matches of clusters that are not suspicious: no match leaves its cluster, so that others need not be made."""
    return matches(records.join(labels.where("not suspicious").select("key"), "key", "left_semi"), settings)


def merge_events(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, members, tier, score): each cluster's best tier and that tier's first score by pair."""
    ok = labels.where(~F.col("suspicious"))
    inside = found.join(ok.select(F.col("key").alias("a"), "rep"), "a")
    best = inside.groupBy("rep").agg(F.min("tier").alias("tier"), F.min_by(F.struct("score"), F.struct("tier", "a", "b"))["score"].alias("score"))
    return ok.groupBy("rep").agg(F.count("*").alias("members")).join(best, "rep")


def merge_conflicts(works: DataFrame, labels: DataFrame, fields: tuple[str, ...] = ("title", "doi", "year", "venue", "type", "language"), precedence: tuple[str, ...] = ()) -> DataFrame:
    """(rep, field, kept, other): fields in which the works of a cluster say different things.

    ``kept`` is what the merge keeps, the value of the best provider that says something, then of the smallest key; ``other``
    is that of the last work, by key, that says something else. Nulls and empty texts say nothing. labels (key, rep).
    """
    rows = works.join(labels.select("key", "rep"), "key")
    place = S.provider_rank(F.transform("provenance", lambda p: p["provider"]), precedence) if "provenance" in works.columns else F.lit(0)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields if f in works.columns))
    said = rows.select("rep", "key", place.alias("rank"), F.inline(each)).where("value <> ''")
    # the first value, and the last that is not it: of the values by their last keys the best or the second
    values = said.groupBy("rep", "field", "value").agg(F.min(F.struct("rank", "key")).alias("first"), F.max("key").alias("last"))
    kept = values.groupBy("rep", "field").agg(F.min_by("value", "first").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return values.join(kept, ["rep", "field"]).where("value <> kept").groupBy("rep", "field", "kept").agg(F.max_by("value", "last").alias("other"))


def _said(c: Column, kind: str) -> Column:
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind.startswith("array"):
        return F.size(c) > 0
    return c.isNotNull()


def merge(works: DataFrame, labels: DataFrame, precedence: tuple[str, ...] = ()) -> DataFrame:
    """One work for each rep: fields from the best provider that says something, provenance united.

    labels (key, rep); a work without label is its own. Works of a cluster are taken by provider rank, then key. The key
    is the smallest; retracted if any is; unresolved if all are; of source_ids the better work's value stays.
    """
    kinds = dict(works.dtypes)
    rows = works.join(labels.select("key", "rep"), "key", "left").withColumn("rep", F.coalesce("rep", "key"))
    providers = F.transform("provenance", lambda p: p["provider"])
    rows = rows.withColumn("ord", F.struct(S.provider_rank(providers, precedence).alias("rank"), F.col("key").alias("k")))
    special = {"key", "provenance", "source_ids", "is_retracted", "unresolved"}
    aggs = [F.min("key").alias("key")]
    for c in works.columns:
        if c not in special:
            aggs.append(F.min_by(F.col(c), F.when(_said(F.col(c), kinds[c]), F.col("ord"))).alias(c))
    pairs = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.map_entries("source_ids").alias("e")))), lambda x: x["e"]))
    first = F.aggregate(pairs, F.expr("array()").cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda a: a["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))))
    aggs += [
        F.map_from_entries(F.array_sort(first)).alias("source_ids"),
        F.bool_or("is_retracted").alias("is_retracted"),
        F.bool_and("unresolved").alias("unresolved"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance")))).alias("provenance"),
    ]
    merged = rows.groupBy("rep").agg(*aggs).drop("rep")
    empty = {"string": F.lit(""), "array": F.array()}
    for c in ("title", "title_norm"):
        if c in works.columns:
            merged = merged.withColumn(c, F.coalesce(c, empty["string"]))
    if "authors" in works.columns:
        merged = merged.withColumn("authors", F.coalesce("authors", F.expr("array()").cast(kinds["authors"])))
    return merged.select(*works.columns)


def upsert(works: DataFrame, merged: DataFrame, aliases: DataFrame) -> DataFrame:
    """The works with merged ones in the place of those they are made of; aliases (key, rep) name the latter."""
    gone = aliases.select("key").union(merged.select("key")).distinct()
    return works.join(gone, "key", "left_anti").select(*works.columns).union(merged.select(*works.columns))


def flatten_aliases(aliases: DataFrame) -> DataFrame:
    """(key, rep) with every chain of renamings followed to its end, loops included."""
    return clusters(aliases.select(F.col("key").alias("a"), F.col("rep").alias("b")))


def apply_aliases(rows: DataFrame, aliases: DataFrame, column: str = "key") -> DataFrame:
    """The rows under their representatives' keys."""
    a = aliases.select(F.col("key").alias(column), F.col("rep").alias("_rep"))
    return rows.join(a, column, "left").withColumn(column, F.coalesce("_rep", column)).drop("_rep").select(*rows.columns)
