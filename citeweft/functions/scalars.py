"""Record normalisation and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import fold

# The prefixes that DOIs are written with, for identity and for membership lists.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi.org/", "doi:", "doi ")
MEMBER_DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")

# What titles of corrections begin with; the first that fits is taken off.
CORRECTION_PREFIXES = ("erratum:", "erratum to:", "correction:", "correction to:", "corrigendum:", "corrigendum to:", "retraction:", "retraction note:", "withdrawn:")

# Words that are no search terms.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can cannot could did do does doing down during each few for from further had has have having he her here hers herself "
    "him himself his how i if in into is it its itself me more most my myself no nor not of off on once only or other ought "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why with "
    "would you your yours yourself yourselves"
).split()


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _either(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def present(text: Column) -> Column:
    """Null for empty."""
    return F.when(text != "", text)


def normalize_doi(raw: Column) -> Column:
    """A bare DOI in lower case, or null if it has not the form of one."""
    s = F.regexp_replace(strip(raw), f"(?i)^(?:{_either(DOI_PREFIXES)})", "")
    s = F.regexp_replace(strip(s), r"^[<>\[\]() ]+|[<>\[\]() ]+$", "")
    s = F.lower(F.regexp_replace(s, r"[.,;]+$", ""))
    return F.when(s.rlike(r"(?U)^10\.\d{4,9}/\S+$"), s)


def normalize_member_doi(raw: Column) -> Column:
    """The comparable form in membership lists: looser than ``normalize_doi``, valid if it begins with ``10.``."""
    s = F.regexp_replace(F.lower(strip(raw)), f"^(?:{_either(MEMBER_DOI_PREFIXES)})", "")
    s = F.regexp_replace(strip(s), r"\.+$", "")
    return F.when(s.startswith("10."), s)


def strip_correction_prefix(title: Column) -> Column:
    """struct(title, is_correction)."""
    s = strip(title)
    pattern = f"(?i)^(?:{_either(CORRECTION_PREFIXES)})"
    return F.struct(strip(F.regexp_replace(s, pattern, "")).alias("title"), s.rlike(pattern).alias("is_correction"))


def normalize_title(raw: Column) -> Column:
    """Folded, without one correction prefix, letters and digits only, single blanks; empty for null."""
    s = F.regexp_replace(strip(fold(raw)), f"^(?:{_either(CORRECTION_PREFIXES)})", "")
    return F.coalesce(F.trim(F.regexp_replace(s, "[^0-9a-z]+", " ")), F.lit(""))


def normalize_surname(raw: Column) -> Column:
    return F.coalesce(F.regexp_replace(fold(raw), "[^a-z]+", ""), F.lit(""))


def normalize_year(raw: Column) -> Column:
    """The earliest number from 1000 to 2999 in a string."""
    found = F.regexp_extract_all(raw, F.lit(r"(1[0-9]{3}|2[0-9]{3})"), 1)
    return F.array_min(F.transform(found, lambda x: x.cast("int")))


def tokenize(text: Column) -> Column:
    """Search terms of a text in order, repeats kept."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(normalize_title(text), " "), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


def normalize_source_id(namespace: str, value: Column) -> Column:
    s = strip(value)
    if namespace == "openalex":
        return present(F.upper(F.regexp_extract(s, r"([Ww]\d+)", 1)))
    if namespace == "s2":
        return present(strip(F.substring_index(s, "/", -1)))
    if namespace == "pmid":
        return present(F.regexp_replace(s, r"\D", ""))
    return present(s)


def signature_key(title: Column, year: Column, surname: Column) -> Column:
    """A key from what a record says of itself, for records without identifier. year: a number or null."""
    said = F.concat_ws("|", normalize_title(title), F.coalesce(year.cast("string"), F.lit("")), normalize_surname(surname))
    return F.concat(F.lit("sig:"), F.substring(F.sha1(said), 1, 16))


def canonical_key(doi: Column, openalex: Column, s2: Column, title: Column, year: Column, surname: Column) -> Column:
    """The first of DOI, OpenAlex id, Semantic Scholar id and signature."""
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(doi)),
        F.concat(F.lit("openalex:"), normalize_source_id("openalex", openalex)),
        F.concat(F.lit("s2:"), normalize_source_id("s2", s2)),
        signature_key(title, year, surname),
    )


def parse_identifier(raw: Column) -> Column:
    """struct(ns, value): doi, openalex, pmid or s2."""
    s = strip(raw)
    low, doi, oa = F.lower(s), normalize_doi(s), normalize_source_id("openalex", s)

    def as_(ns: str, value: Column) -> Column:
        return F.struct(F.lit(ns).alias("ns"), value.alias("value"))

    return (
        F.when(doi.isNotNull(), as_("doi", doi))
        .when((s.rlike(r"^[Ww]\d+$") | low.contains("openalex.org")) & oa.isNotNull(), as_("openalex", oa))
        .when(low.startswith("pmid:"), as_("pmid", F.regexp_replace(s, r"\D", "")))
        .when(s.rlike(r"^\d+$"), as_("pmid", s))
        .when(low.rlike("^(s2|corpusid):"), as_("s2", strip(F.regexp_replace(s, "^[^:]*:", ""))))
        .otherwise(as_("s2", s))
    )


def blocking_keys(title_norm: Column, year: Column) -> Column:
    """The blocks a record stands in: the head of its title with its two-year bucket and the neighbour's."""
    head = F.substring(F.coalesce(title_norm, F.lit("")), 1, 12)
    pair = F.array(F.concat(head, F.lit("|"), F.floor(year / 2).cast("string")), F.concat(head, F.lit("|"), F.floor((year + 1) / 2).cast("string")))
    return F.when(year.isNull(), F.array(F.concat(head, F.lit("|noyear")))).otherwise(F.array_distinct(pair))


def same_first_author(a: Column, b: Column) -> Column:
    """Folded surnames are equal, or one of four letters or more ends the other, which has three more at most."""
    ends = lambda x, y: x.endswith(y) & (F.length(y) >= 4) & (F.length(x) - F.length(y) <= 3)
    return F.coalesce((a != "") & (b != "") & ((a == b) | ends(a, b) | ends(b, a)), F.lit(False))


def year_close(a: Column, b: Column, tolerance: int = 1) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def provider_rank(providers: Column, precedence: tuple[str, ...]) -> Column:
    """The smallest place of any provider in the precedence; its length if none is there; 0 without precedence."""
    if not precedence:
        return F.lit(0)
    places = F.create_map(*(x for k, p in enumerate(precedence) for x in (F.lit(p), F.lit(k))))
    return F.coalesce(F.array_min(F.transform(providers, lambda p: F.coalesce(F.try_element_at(places, p), F.lit(len(precedence))))), F.lit(len(precedence)))


def yield_rate(included: Column, screened: Column) -> Column:
    return F.coalesce(F.try_divide(included, screened), F.lit(0.0))


def field_conflicts(a: str, b: str, fields: tuple[str, ...] = ("title", "doi", "year", "venue", "type", "language")) -> Column:
    """Fields in which two structs both say something, and not the same: array of struct(field, a, b)."""
    one = []
    for f in fields:
        x, y = F.col(f"{a}.{f}").cast("string"), F.col(f"{b}.{f}").cast("string")
        one.append(F.when((x != "") & (y != "") & (x != y), F.struct(F.lit(f).alias("field"), x.alias("a"), y.alias("b"))))
    return F.array_compact(F.array(*one))


def request_key(provider: Column, method: Column, params_json: Column) -> Column:
    """The content address of a request; params: canonical JSON."""
    return F.sha2(F.concat_ws("|", provider, method, params_json), 256)


def response_hash(body_json: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body_json, 256))


def inverted_abstract(index: Column) -> Column:
    """Text from a map of token to positions, by position, then token; null if there is none."""
    each = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return present(F.array_join(F.transform(F.array_sort(each), lambda x: x["t"]), " "))


def bib_key(surname: Column, year: Column, title: Column) -> Column:
    """Letters of the surname, the year and the first title word of more than three letters, lower case."""
    word = F.get(F.filter(F.split(normalize_title(title), " "), lambda x: F.length(x) > 3), F.lit(0))
    return F.concat(F.coalesce(present(normalize_surname(surname)), F.lit("anon")), F.coalesce(year.cast("string"), F.lit("nd")), F.coalesce(word, F.lit("")))
