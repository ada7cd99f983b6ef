"""Graph files, lists and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import AUTHOR, CACHE_DDL

GRAPH_WORK = f"struct<title:string,title_norm:string,doi:string,abstract:string,year:int,authors:array<{AUTHOR}>,venue:string,type:string,language:string,is_retracted:boolean,unresolved:boolean,source_ids:map<string,string>,reference_count:int,cited_by_count:int>"
GRAPH = f"works map<string,{GRAPH_WORK}>, references map<string,array<string>>, citations map<string,array<string>>"


def graph(spark: SparkSession, path: str, provider: str = "offline") -> tuple[DataFrame, DataFrame]:
    """works and edges of a frozen graph file {works, references, citations}; keys go into the works.

    References are backward edges, citations forward ones; neither is derived from the other.
    """
    raw = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    w = raw.select(F.explode("works").alias("key", "w")).select("key", "w.*")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("title", "title_norm")} | {c: F.coalesce(c, F.lit(False)) for c in ("is_retracted", "unresolved")}

    def side(column: str, direction: str) -> DataFrame:
        return raw.select(F.explode(column).alias("src", "to")).select("src", F.explode("to").alias("dst"), F.lit(direction).alias("direction"), F.lit(provider).alias("provider"))

    edges = side("references", "backward").union(side("citations", "forward")).distinct()
    return w.withColumns(blank), edges


def _names(works: DataFrame) -> DataFrame:
    """The works' rows for each of their names, ``ident``."""
    ids = F.flatten(F.transform(F.map_entries(F.coalesce("source_ids", F.expr("cast(map() as map<string,string>)"))), lambda e: F.array(F.concat(e["key"], F.lit(":"), e["value"]), e["value"])))
    doi = F.when(F.col("doi").isNotNull(), F.array(F.col("doi"), F.concat(F.lit("doi:"), "doi"))).otherwise(F.expr("cast(array() as array<string>)"))
    return works.withColumn("ident", F.explode(F.array_distinct(F.concat(F.array("key"), doi, ids))))


def aliases(works: DataFrame) -> DataFrame:
    """(ident, key): all names of a work; where two claim one, the later key in order wins."""
    return _names(works).groupBy("ident").agg(F.max("key").alias("key"))


def aliases_by_provider(works: DataFrame) -> DataFrame:
    """(ident, key, provider): all names of a work, for each provider of its provenance; provider is '' where there is none."""
    none = F.array(F.lit(""))
    if "provenance" in works.columns:
        of = F.array_distinct(F.transform("provenance", lambda p: F.coalesce(p["provider"], F.lit(""))))
        none = F.when(F.size(of) > 0, of).otherwise(none)
    names = works.withColumn("provider", F.explode(none))
    return _names(names).groupBy("ident", "provider").agg(F.max("key").alias("key")).select("ident", "key", "provider")


def resolve_identifiers(idents: DataFrame, names: DataFrame) -> DataFrame:
    """(ident, key): exact names first, then in lower case; key is null where none fits."""
    low = names.groupBy(F.lower("ident").alias("low")).agg(F.max("key").alias("low_key"))
    rows = idents.select("ident").distinct().join(names, "ident", "left").withColumn("low", F.lower("ident"))
    return rows.join(low, "low", "left").select("ident", F.coalesce("key", "low_key").alias("key"))


def resolve_seeds(idents: DataFrame, names: DataFrame, order: list[str]) -> DataFrame:
    """(ident, key, provider): each identifier at the first provider, in order, that knows it; null where none does.

    names (ident, key, provider): what each provider knows a work by. Providers that order leaves out come last, by name.
    An identifier is looked up in its normal form, with and without its namespace, then as it stands.
    """
    asked = idents.select("ident").distinct().withColumn("p", S.parse_identifier(F.col("ident")))
    forms = F.array(F.col("p.value"), F.concat("p.ns", F.lit(":"), "p.value"), S.strip(F.col("ident")))
    asked = asked.select("ident", F.posexplode(forms).alias("place", "form"))
    place = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("provider"))
    known = names.select(F.col("ident").alias("form"), "key", "provider", F.when(place > 0, place).otherwise(len(order) + 1).alias("rank"))
    best = F.min_by(F.struct("key", "provider"), F.when(F.col("key").isNotNull(), F.struct("rank", "provider", "place", "key")))
    return asked.join(known, "form", "left").groupBy("ident").agg(best.alias("b")).select("ident", "b.key", "b.provider")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers of a seeds file, one a line; comments and blank lines are left out."""
    return spark.read.text(path).select(S.strip(F.col("value")).alias("ident")).where("ident <> '' and ident not like '#%'").distinct()


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("maxCharsPerColumn", -1).option("encoding", "UTF-8").csv(path)


def _plain(df: DataFrame) -> DataFrame:
    """Column names without byte-order mark, blanks and capitals."""
    return df.toDF(*(c.lstrip("﻿").strip().lower() for c in df.columns))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(key, decision) of a labels file; blank ones are left out, of repeated keys the last row counts."""
    rows = _plain(_csv(spark, path)).select(S.strip(F.col("key")).alias("key"), F.lower(S.strip(F.col("decision"))).alias("decision"), F.monotonically_increasing_id().alias("ord"))
    return rows.where("key <> '' and decision <> ''").groupBy("key").agg(F.max_by("decision", "ord").alias("decision"))


def membership(spark: SparkSession, path: str, name: str, column: str = "doi") -> tuple[DataFrame, dict[str, int]]:
    """(set_name, doi) of a membership list, and how many rows it has and how many lack a DOI."""
    df = _plain(_csv(spark, path))
    if column.lower() not in df.columns:
        raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
    rows = df.select(S.normalize_member_doi(F.col(column.lower())).alias("doi"))
    n = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("doi").isNull()).alias("without_doi")).collect()[0].asDict()
    return rows.where("doi is not null").distinct().select(F.lit(name).alias("set_name"), "doi"), n


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a gold standard: CSV, or JSON as a list or under ``included``; key, DOI or signature names a work."""
    if path.endswith(".csv"):
        df = _plain(_csv(spark, path))
    else:
        text = spark.read.text(path, wholetext=True)
        kind = "array<struct<key:string,doi:string,title:string,year:string,author:string>>"
        body = F.coalesce(F.get_json_object("value", "$.included"), F.col("value"))
        df = text.select(F.explode(F.from_json(body, kind)).alias("x")).select("x.*")
    for c in ("key", "doi", "title", "year", "author"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    named = F.coalesce(S.present(S.strip(F.col("key"))), F.concat(F.lit("doi:"), S.normalize_doi(F.col("doi"))), S.signature_key(F.col("title"), S.normalize_year(F.col("year")), F.col("author")))
    return df.select(named.alias("key")).distinct()


def pdf_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, path) rows that have both."""
    df = _plain(_csv(spark, path))
    return df.select(S.strip(F.col("key")).alias("key"), S.strip(F.col("path")).alias("path")).where("key <> '' and path <> ''")


def audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a response cache, one JSON file each, in folders by the first two characters of the key.

    ``params`` and ``body`` stay JSON text.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    names = [c.strip().split(" ")[0] for c in CACHE_DDL.split(",")]
    get = lambda n: F.get_json_object("value", f"$.{n}").alias(n)
    rows = raw.select(*(get(n) for n in names))
    return rows.withColumn("http_status", F.col("http_status").cast("int"))


REGISTRY = ("openalex", "crossref", "semanticscholar", "grobid")


def providers(enabled: dict[str, bool], offline: bool = False) -> list[str]:
    """Names of the providers of a run in their order; an offline graph stands for all of them."""
    return ["offline"] if offline else [p for p in REGISTRY if enabled.get(p)]
