"""Landed JSON responses of citation providers, as works; each row holds one response's text in ``body``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import AUTHOR, PROVENANCE

OPENALEX = (
    "struct<id:string,doi:string,title:string,display_name:string,publication_year:int,type:string,language:string,is_retracted:boolean,"
    "authorships:array<struct<author:struct<display_name:string,orcid:string>>>,primary_location:struct<source:struct<display_name:string>>,"
    "ids:map<string,string>,referenced_works:array<string>,referenced_works_count:int,cited_by_count:int,abstract_inverted_index:map<string,array<int>>>"
)
CROSSREF_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    "struct<DOI:string,title:array<string>,`container-title`:array<string>,type:string,language:string,abstract:string,"
    "author:array<struct<family:string,given:string,ORCID:string>>,"
    f"`published-print`:{CROSSREF_DATE},`published-online`:{CROSSREF_DATE},issued:{CROSSREF_DATE},created:{CROSSREF_DATE},"
    "`references-count`:int,`is-referenced-by-count`:int,"
    "reference:array<struct<key:string,DOI:string,`article-title`:string,`volume-title`:string,unstructured:string,author:string,year:string,`journal-title`:string>>>"
)
SCHOLAR = (
    "struct<paperId:string,externalIds:map<string,string>,title:string,abstract:string,year:int,venue:string,"
    "authors:array<struct<name:string>>,publicationTypes:array<string>,referenceCount:int,citationCount:int>"
)


def _last(name: Column) -> Column:
    """The last word of a name, and what stands before it."""
    parts = F.split(F.trim(name), r"\s+")
    return F.element_at(parts, -1)


def _author(surname: Column, given: Column, orcid: Column) -> Column:
    return F.struct(surname.alias("surname"), given.alias("given"), orcid.alias("orcid"))


def _ids(**ids: Column) -> Column:
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(ids.items()))), lambda x: x["value"].isNotNull())
    return F.map_from_entries(pairs)


def _works(rows: DataFrame, *keep: str, **c: Column) -> DataFrame:
    """Rows in the shape of works, with columns to keep; what a provider does not know is null."""
    surname = F.get(c["authors"], F.lit(0))["surname"]
    ids = c["source_ids"]
    key = S.canonical_key(c["doi"], F.try_element_at(ids, F.lit("openalex")), F.try_element_at(ids, F.lit("s2")), c["title"], c["year"], surname)
    null = F.lit(None).cast("string")
    return rows.select(
        *keep,
        key.alias("key"),
        F.coalesce(c["title"], F.lit("")).alias("title"),
        S.normalize_title(c["title"]).alias("title_norm"),
        S.normalize_doi(c["doi"]).alias("doi"),
        c.get("abstract", null).alias("abstract"),
        c["year"].cast("int").alias("year"),
        F.coalesce(c["authors"], F.expr("array()").cast(f"array<{AUTHOR}>")).cast(f"array<{AUTHOR}>").alias("authors"),
        c.get("venue", null).alias("venue"),
        c.get("type", null).alias("type"),
        c.get("language", null).alias("language"),
        F.coalesce(c.get("is_retracted", F.lit(False)), F.lit(False)).alias("is_retracted"),
        c.get("unresolved", F.lit(False)).alias("unresolved"),
        ids.alias("source_ids"),
        c.get("reference_count", F.lit(None)).cast("int").alias("reference_count"),
        c.get("cited_by_count", F.lit(None)).cast("int").alias("cited_by_count"),
        F.expr("array()").cast(f"array<{PROVENANCE}>").alias("provenance"),
    )


def openalex(responses: DataFrame) -> DataFrame:
    """Works from OpenAlex work objects; rows that are no work are left out."""
    rows = responses.select(F.from_json("body", OPENALEX).alias("w")).where("w.id is not null or w.title is not null or w.display_name is not null")
    authors = F.transform("w.authorships", lambda a: _author(_last(a["author"]["display_name"]), S.present(F.regexp_replace(F.trim(a["author"]["display_name"]), r"\s*\S+$", "")), a["author"]["orcid"]))
    return _works(
        rows,
        doi=F.col("w.doi"),
        title=F.coalesce("w.title", "w.display_name"),
        year=F.col("w.publication_year"),
        authors=F.filter(authors, lambda a: a["surname"].isNotNull()),
        venue=F.col("w.primary_location.source.display_name"),
        type=F.col("w.type"),
        language=F.col("w.language"),
        is_retracted=F.col("w.is_retracted"),
        abstract=S.inverted_abstract(F.col("w.abstract_inverted_index")),
        source_ids=_ids(openalex=S.normalize_source_id("openalex", F.col("w.id")), pmid=S.normalize_source_id("pmid", F.try_element_at("w.ids", F.lit("pmid")))),
        reference_count=F.coalesce("w.referenced_works_count", F.when(F.col("w.referenced_works").isNotNull(), F.size("w.referenced_works"))),
        cited_by_count=F.col("w.cited_by_count"),
    )


def _year(item: str) -> Column:
    """The first year of print, online, issued and created dates."""
    dates = (f"{item}.`published-print`", f"{item}.`published-online`", f"{item}.issued", f"{item}.created")
    return F.coalesce(*(F.get(F.get(F.col(f"{d}.`date-parts`"), F.lit(0)), F.lit(0)) for d in dates))


def crossref(responses: DataFrame) -> DataFrame:
    """Works from Crossref items, bare or under ``message``; those with neither title nor DOI are left out."""
    body = F.coalesce(F.get_json_object("body", "$.message"), F.col("body"))
    rows = responses.select(F.from_json(body, CROSSREF).alias("w"))
    first = lambda c: S.present(S.strip(F.get(F.col(c), F.lit(0))))
    rows = rows.where(first("w.title").isNotNull() | (F.col("w.DOI") != ""))
    authors = F.transform(F.filter("w.author", lambda a: a["family"] != ""), lambda a: _author(a["family"], a["given"], a["ORCID"]))
    return _works(
        rows,
        doi=F.col("w.DOI"),
        title=first("w.title"),
        year=_year("w"),
        authors=authors,
        venue=first("w.`container-title`"),
        type=F.col("w.type"),
        language=F.col("w.language"),
        abstract=F.col("w.abstract"),
        source_ids=_ids(crossref=S.normalize_doi(F.col("w.DOI"))),
        reference_count=F.col("w.`references-count`"),
        cited_by_count=F.col("w.`is-referenced-by-count`"),
    )


def crossref_references(responses: DataFrame) -> DataFrame:
    """Works from the reference lists of Crossref items, with their parent's DOI; unresolved where they name no DOI."""
    body = F.coalesce(F.get_json_object("body", "$.message"), F.col("body"))
    rows = responses.select(F.from_json(body, CROSSREF).alias("w")).select(S.normalize_doi(F.col("w.DOI")).alias("parent"), F.explode("w.reference").alias("r"))
    title = F.coalesce(*(S.present(S.strip(F.col(f"r.`{c}`"))) for c in ("article-title", "volume-title", "unstructured")))
    doi = S.normalize_doi(F.col("r.DOI"))
    author = S.present(S.strip(F.col("r.author")))
    works = rows.withColumns({"t": title, "d": doi, "a": F.when(author.isNotNull(), F.array(_author(_last(author), F.lit(None).cast("string"), F.lit(None).cast("string"))))})
    works = works.where("t is not null or d is not null")
    return _works(works, doi=F.col("d"), title=F.col("t"), year=S.normalize_year(F.col("r.year")), authors=F.col("a"), venue=F.col("r.`journal-title`"), unresolved=F.col("d").isNull(), source_ids=_ids(crossref=F.col("d")))


def _scholar(rows: DataFrame, *keep: str) -> DataFrame:
    """Works from papers in column ``w``, with columns to keep; the type is the first publication type in lower case."""
    rows = rows.where("w.paperId is not null or w.title is not null")
    null = F.lit(None).cast("string")
    authors = F.transform("w.authors", lambda a: _author(_last(a["name"]), S.present(F.regexp_replace(F.trim(a["name"]), r"\s*\S+$", "")), null))
    return _works(
        rows,
        *keep,
        doi=F.try_element_at("w.externalIds", F.lit("DOI")),
        title=F.col("w.title"),
        year=F.col("w.year"),
        authors=authors,
        venue=S.present(F.col("w.venue")),
        type=F.lower(F.get("w.publicationTypes", F.lit(0))),
        abstract=F.col("w.abstract"),
        source_ids=_ids(s2=S.normalize_source_id("s2", F.col("w.paperId")), pmid=S.normalize_source_id("pmid", F.try_element_at("w.externalIds", F.lit("PubMed")))),
        reference_count=F.col("w.referenceCount"),
        cited_by_count=F.col("w.citationCount"),
    )


def semantic_scholar(responses: DataFrame) -> DataFrame:
    """Works from Semantic Scholar papers."""
    return _scholar(responses.select(F.from_json("body", SCHOLAR).alias("w")))


def semantic_scholar_pages(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works, and edges (src, dst, direction, provider), from pages of references and citations (key, body).

    key is the work that was asked about. A page of references holds its cited papers, one of citations its citing
    papers; the edge goes from the work asked about to the paper found, as the crawl follows it. All landed pages are
    read, in any order, and a paper on two of them counts once.
    """
    page = f"struct<data:array<struct<citedPaper:{SCHOLAR},citingPaper:{SCHOLAR}>>>"
    rows = responses.select("key", F.explode(F.from_json("body", page)["data"]).alias("r"))
    rows = rows.select(F.col("key").alias("asked"), F.coalesce("r.citedPaper", "r.citingPaper").alias("w"), F.when(F.col("r.citedPaper").isNotNull(), "backward").otherwise("forward").alias("direction"))
    found = _scholar(rows, "asked", "direction")
    edges = found.where("asked is not null").select(F.col("asked").alias("src"), F.col("key").alias("dst"), "direction", F.lit("semanticscholar").alias("provider")).distinct()
    return found.drop("asked", "direction").dropDuplicates(["key"]), edges


def tei_references(files: DataFrame) -> DataFrame:
    """(path, ord, title, surnames, year, journal, doi) of the references in TEI documents (path, xml).

    Each biblStruct with a title or an author; malformed documents give no rows. The documents are cut at their
    biblStructs first, so that the XPath functions work on small parts.
    """
    cut = F.regexp_extract_all("xml", F.lit(r"(?s)(<biblStruct\b.*?</biblStruct>)"), 1)
    whole = F.col("xml").rlike(r"(?s)</TEI>\s*$")
    rows = files.where(whole).select("path", F.posexplode(F.transform(cut, lambda x: F.regexp_replace(x, r'\sxml:id="[^"]*"', ""))).alias("ord", "b"))
    text = lambda p: S.present(S.strip(F.xpath_string("b", F.lit(p))))
    out = rows.select(
        "path",
        "ord",
        F.coalesce(text("//title[@level='a']"), text("//title")).alias("title"),
        F.filter(F.xpath("b", F.lit("//author/persName/surname/text()")), lambda x: x != "").alias("surnames"),
        S.normalize_year(text("//date[@type='published']/@when")).alias("year"),
        text("//title[@level='j']").alias("journal"),
        S.normalize_doi(text("//idno[@type='DOI']")).alias("doi"),
    )
    return out.where("title is not null or size(surnames) > 0")


def match_references(references: DataFrame, candidates: DataFrame, least_score: float = 60, least_similarity: float = 0.90) -> DataFrame:
    """References with the DOI of their best candidate (path, ord, doi, score, title, year, cand_ord), and a confidence.

    A candidate must score enough, have a similar title and a year at most one apart where both are known; the most
    similar one wins, the first of equals. A reference's own DOI has confidence 100.
    """
    from pyspark.sql import Window

    from ..functions.udfs import similarity

    c = candidates.select("path", "ord", "cand_ord", F.col("doi").alias("c_doi"), F.col("score").alias("c_score"), F.col("title").alias("c_title"), F.col("year").alias("c_year"))
    both = references.where("doi is null").join(c, ["path", "ord"]).where((F.col("c_score") >= least_score) & (F.col("year").isNull() | F.col("c_year").isNull() | (F.abs(F.col("year") - F.col("c_year")) <= 1)))
    both = both.withColumn("jw", similarity(S.normalize_title(F.col("title")), S.normalize_title(F.col("c_title")))).where(F.col("jw") >= least_similarity)
    best = both.withColumn("k", F.row_number().over(Window.partitionBy("path", "ord").orderBy(F.desc("jw"), "cand_ord"))).where("k = 1").select("path", "ord", S.normalize_doi(F.col("c_doi")).alias("found"), (100 * F.col("jw")).alias("found_confidence"))
    out = references.join(best, ["path", "ord"], "left")
    return out.withColumn("confidence", F.when(F.col("doi").isNotNull(), F.lit(100.0)).otherwise(F.col("found_confidence"))).withColumn("doi", F.coalesce("doi", "found")).drop("found", "found_confidence")


def tei_works(references: DataFrame) -> DataFrame:
    """Matched references as works; the confidence of the match is kept among the source ids."""
    null = F.lit(None).cast("string")
    authors = F.transform("surnames", lambda x: _author(x, null, null))
    return _works(references, doi=F.col("doi"), title=F.col("title"), year=F.col("year"), authors=authors, venue=F.col("journal"), unresolved=F.col("doi").isNull(), source_ids=_ids(grobid_confidence=F.format_string("%.1f", "confidence")))


def with_own_candidates(references: DataFrame, works: DataFrame, least_similarity: float = 0.90) -> DataFrame:
    """As ``match_references``, with candidates from works (key, title_norm, title, doi, year) by an index of their titles."""
    from ..operators.similar import match_bibliographic

    named = references.withColumn("title_norm", S.normalize_title(F.col("title")))
    found = match_bibliographic(named.where("doi is null").select("path", "ord", "title_norm"), works, least_similarity)
    return match_references(references, found, 0, least_similarity)
