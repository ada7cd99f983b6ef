"""The registry: every query of the engine on the driver's tables, with SQL where SQL can say it.

Doubles are rounded to six places on both sides; counts are longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.udfs import canonical_json
from ..model import Eligibility
from ..operators import eligibility, estimate, expand, loglinear, prisma, rank, resolve, simulate, stats, stopping, verify
from ..sinks import exports
from ..sources import files
from ..storage import durable
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def longs(df: DataFrame) -> DataFrame:
    """Integers as longs, doubles rounded."""
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- records: scans, normalisation, keys -------------------------------------------------------------------------


@query(f"WITH {A.SQL_WORKS} SELECT * REPLACE (year::BIGINT AS year) FROM works")
def scan_works(spark, d):
    return longs(A.works(spark, d))


DOI_FORMS = ["https://doi.org/10.1000/AB{n}.", "doi:10.1000/ab{n}", "  10.1000/ab{n};", "http://dx.doi.org/10.1000/Ab{n},", "not a doi {n}", "<10.1000/ab{n}>", "10.1/ab{n}", "DOI 10.1000/AB{n}"]


def _raw_ids(spark, d):
    forms = F.array(*map(F.lit, DOI_FORMS))
    p = A.table(spark, d, "pages")
    return p.select("page_id", F.replace(F.get(forms, (F.col("page_id") % len(DOI_FORMS)).cast("int")), F.lit("{n}"), F.col("page_id").cast("string")).alias("raw"))


SQL_RAW = "raw AS (SELECT page_id, replace(([" + ", ".join(f"'{x}'" for x in DOI_FORMS) + f"])[page_id % {len(DOI_FORMS)} + 1], '{{n}}', page_id::VARCHAR) AS raw FROM pages)"
SQL_DOI = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/|doi\.org/|doi:|doi )', '', 'i'), '^[<>\[\]() ]+', ''), '[<>\[\]() ]+$', ''), '[.,;]+$', ''))"


@query(f"WITH {SQL_RAW}, s AS (SELECT page_id, raw, {SQL_DOI.format('raw')} AS s FROM raw) SELECT page_id, raw, CASE WHEN regexp_full_match(s, '10\\.\\d{{4,9}}/\\S+') THEN s END AS doi FROM s")
def norm_doi(spark, d):
    return _raw_ids(spark, d).withColumn("doi", S.normalize_doi(F.col("raw")))


@query(rf"WITH {SQL_RAW}, s AS (SELECT page_id, raw, regexp_replace(trim(regexp_replace(lower(trim(raw)), '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/|doi:)', '')), '\.+$', '') AS s FROM raw) SELECT page_id, raw, CASE WHEN starts_with(s, '10.') THEN s END AS doi FROM s")
def norm_doi_membership(spark, d):
    return _raw_ids(spark, d).withColumn("doi", S.normalize_member_doi(F.col("raw")))


@query(f"WITH {A.SQL_TEXT} SELECT key, title_norm FROM tn")
def norm_title(spark, d):
    return A.text_works(spark, d).select("key", S.normalize_title(F.col("title")).alias("title_norm"))


@query(r"SELECT doc_id, regexp_replace(replace(lower(strip_accents(split_part(text, ' ', 2))), 'ß', 'ss'), '[^a-z]+', '', 'g') AS surname FROM documents")
def norm_surname(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.normalize_surname(F.split_part("text", F.lit(" "), F.lit(2))).alias("surname"))


@query("SELECT o_orderkey AS key, list_min(list_transform(regexp_extract_all(o_orderdate::VARCHAR || ' ' || (900 + o_orderkey % 3000)::VARCHAR, '(1[0-9]{3}|2[0-9]{3})'), lambda x: x::INT))::BIGINT AS year FROM orders")
def norm_year(spark, d):
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), (900 + F.col("o_orderkey") % 3000).cast("string"))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), S.normalize_year(raw).cast("long").alias("year"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in S.STOPWORDS) + "]"


@query(f"WITH {A.SQL_TEXT} SELECT key, array_to_string(list_filter(string_split(title_norm, ' '), lambda x: length(x) > 1 AND NOT list_contains({STOP_SQL}, x)), ' ') AS terms FROM tn")
def tokenize_docs(spark, d):
    return A.text_works(spark, d).select("key", F.array_join(S.tokenize(F.col("title")), " ").alias("terms"))


@query(f"WITH {A.SQL_TEXT} SELECT key, 'sig:' || substr(sha1(title_norm || '|' || year::VARCHAR || '|' || surname), 1, 16) AS signature FROM tn")
def signature_key(spark, d):
    return A.text_works(spark, d).select("key", S.signature_key(F.col("title"), F.col("year"), F.col("surname_raw")).alias("signature"))


@query(
    f"""WITH {A.SQL_TEXT} SELECT key, CASE WHEN doc_id % 4 = 0 THEN 'doi:' || doi WHEN doc_id % 4 = 1 THEN 'openalex:W' || doc_id
    WHEN doc_id % 4 = 2 THEN 's2:' || doc_id ELSE 'sig:' || substr(sha1(title_norm || '|' || year::VARCHAR || '|' || surname), 1, 16) END AS canonical FROM tn"""
)
def canonical_key(spark, d):
    kind = F.col("doc_id") % 4
    t = A.text_works(spark, d)
    return t.select(
        "key",
        S.canonical_key(
            F.when(kind == 0, F.col("doi_raw")),
            F.when(kind <= 1, F.format_string("https://openalex.org/w%d", "doc_id")),
            F.when(kind == 2, F.format_string("https://api.semanticscholar.org/paper/%d", "doc_id")),
            F.col("title"),
            F.col("year"),
            F.col("surname_raw"),
        ).alias("canonical"),
    )


ID_FORMS = ["10.1000/x{n}", "W{n}", "https://openalex.org/w{n}", "pmid: {n}", "{n}", "CorpusId:{n}", "s2: {n}", "abc{n}"]
ID_SQL = "raw AS (SELECT page_id, replace(([" + ", ".join(f"'{x}'" for x in ID_FORMS) + f"])[page_id % {len(ID_FORMS)} + 1], '{{n}}', page_id::VARCHAR) AS raw FROM pages)"


@query(
    f"""WITH {ID_SQL} SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'doi' WHEN 1 THEN 'openalex' WHEN 2 THEN 'openalex' WHEN 3 THEN 'pmid' WHEN 4 THEN 'pmid' ELSE 's2' END AS ns,
    CASE page_id % 8 WHEN 0 THEN raw WHEN 1 THEN raw WHEN 2 THEN 'W' || page_id WHEN 7 THEN raw ELSE page_id::VARCHAR END AS value FROM raw"""
)
def parse_identifier(spark, d):
    forms = F.array(*map(F.lit, ID_FORMS))
    raw = F.replace(F.get(forms, (F.col("page_id") % len(ID_FORMS)).cast("int")), F.lit("{n}"), F.col("page_id").cast("string"))
    return A.table(spark, d, "pages").select("page_id", S.parse_identifier(raw).alias("x")).select("page_id", "x.ns", "x.value")


@query("SELECT page_id, 'W' || page_id AS openalex, page_id::VARCHAR || '7' AS pmid, string_split(url, '/')[-1] AS tail FROM pages")
def source_id(spark, d):
    p = A.table(spark, d, "pages")
    oa, pm = F.format_string("https://openalex.org/w%d", "page_id"), F.format_string("PMID %d-7", "page_id")
    return p.select("page_id", S.normalize_source_id("openalex", oa).alias("openalex"), S.normalize_source_id("pmid", pm).alias("pmid"), F.coalesce(S.normalize_source_id("s2", F.col("url")), F.lit("")).alias("tail"))


@query(f"WITH {A.SQL_TEXT} SELECT DISTINCT key, unnest([substr(title_norm, 1, 12) || '|' || (year // 2)::VARCHAR, substr(title_norm, 1, 12) || '|' || ((year + 1) // 2)::VARCHAR]) AS block FROM tn")
def blocking_keys(spark, d):
    t = A.text_works(spark, d).withColumn("title_norm", S.normalize_title(F.col("title")))
    return t.select("key", F.explode(S.blocking_keys(F.col("title_norm"), F.col("year"))).alias("block"))


@query("""SELECT event_id, sha256(event_type || '|get|' || '{"k":' || regexp_extract(props, '([0-9]+)', 1) || '}') AS cache_key, 'sha256:' || sha256('{"k":' || regexp_extract(props, '([0-9]+)', 1) || '}') AS body_hash FROM events""")
def cache_key_hash(spark, d):
    e = A.table(spark, d, "events").withColumn("params", canonical_json("props"))
    return e.select("event_id", S.request_key(F.col("event_type"), F.lit("get"), F.col("params")).alias("cache_key"), S.response_hash(F.col("params")).alias("body_hash"))


@query("SELECT item_id, nullif(array_to_string(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' '), '') AS abstract FROM benchmark")
def abstract_invert(spark, d):
    """Texts as inverted indexes, and back."""
    ws = A.table(spark, d, "benchmark").select("item_id", F.posexplode(F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda x: x != "")).alias("pos", "tok"))
    index = ws.groupBy("item_id", "tok").agg(F.collect_list("pos").alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", "at"))).alias("index"))
    return index.select("item_id", S.inverted_abstract(F.col("index")).alias("abstract"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::BIGINT AS n_links, list_aggregate(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 'min') AS first_link FROM pages")
def page_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return A.table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.array_min(links).alias("first_link"))


# --- graph -------------------------------------------------------------------------------------------------------


@query(f"WITH {A.SQL_EDGES} SELECT * FROM edges")
def edges_backward(spark, d):
    return A.edges(spark, d)


@query(f"WITH {A.SQL_EDGES} SELECT dst AS src, src AS dst, 'forward' AS direction, provider FROM edges")
def edges_forward(spark, d):
    return A.edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("forward").alias("direction"), "provider")


@query(f"WITH {A.SQL_EDGES}, {A.SQL_GOLD}, {A.SQL_SEEDS} SELECT DISTINCT s.trial, e.src AS parent, e.dst AS key, e.provider, e.direction FROM edges e JOIN seeds s ON s.key = e.src")
def expand_frontier(spark, d):
    return expand.neighbours(A.edges(spark, d), A.seeds(spark, d), A.works(spark, d)).select("trial", "parent", "key", "provider", "direction")


def crawl(spark, d) -> DataFrame:
    return expand.snowball(A.edges(spark, d), A.seeds(spark, d), A.gold(spark, d))


@query(f"WITH RECURSIVE {A.SQL_REACH} SELECT key, n::BIGINT AS n, included FROM found")
def snowball_reach(spark, d):
    return longs(crawl(spark, d).select("key", "n", "included"))


@query(f"WITH RECURSIVE {A.SQL_HISTORY} SELECT n::BIGINT AS n, n_screened, n_included, cumulative_screened, cumulative_included, frontier_size, round(yield_rate, 6) AS yield_rate FROM history")
def snowball_history(spark, d):
    return longs(expand.history(crawl(spark, d)).drop("trial"))


@query(
    f"""WITH RECURSIVE {A.SQL_REACH}, ways AS (SELECT DISTINCT e.dst AS key, e.provider, e.src AS parent FROM edges e JOIN found p ON p.key = e.src AND p.included JOIN found k ON k.key = e.dst)
    SELECT key, array_to_string(list_sort(list(DISTINCT provider)), '|') AS providers, count(DISTINCT parent)::BIGINT AS n_parents, min(parent) AS first_parent FROM ways GROUP BY key"""
)
def provenance_rollup(spark, d):
    e = A.edges(spark, d)
    p = expand.provenance(crawl(spark, d), e)
    return p.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("provider")), "|").alias("providers"), F.count_distinct("parent").alias("n_parents"), F.min("parent").alias("first_parent"))


@query(f"WITH RECURSIVE {A.SQL_REACH} SELECT e.src AS u, e.dst AS v, max(e.provider) AS provider FROM edges e JOIN found p ON p.key = e.src AND p.included JOIN found k ON k.key = e.dst GROUP BY 1, 2")
def graph_edges_export(spark, d):
    """Edges of the citation graph among found works; of repeated ones the last by provider."""
    p = expand.provenance(crawl(spark, d), A.edges(spark, d))
    return p.groupBy(F.col("parent").alias("u"), F.col("key").alias("v")).agg(F.max("provider").alias("provider"))


@query(f"WITH {A.SQL_EDGES}, {A.SQL_GOLD}, {A.SQL_SEEDS}, kids AS (SELECT DISTINCT dst AS key FROM edges JOIN seeds ON key = src) SELECT key FROM kids EXCEPT SELECT key FROM seeds")
def frontier_enqueue(spark, d):
    s = A.seeds(spark, d)
    kids = expand.neighbours(A.edges(spark, d), s)
    return expand.enqueue(kids, s, kids.limit(0))


# --- eligibility -------------------------------------------------------------------------------------------------

CRITERIA = Eligibility(year_min=1975, year_max=2010, types=("ECONOMY", "STANDARD", "PROMO"), languages=("en",), require_abstract=True)
STRICT = Eligibility(year_min=1975, types=("ECONOMY",), languages=("en",), keep_unknown=False)
SQL_REASON = """CASE WHEN coalesce(trim(title), '') = '' THEN 'no_title' WHEN coalesce(trim(abstract), '') = '' THEN 'no_abstract' WHEN is_retracted THEN 'retracted'
  WHEN year < 1975 THEN 'year_below_min' WHEN year > 2010 THEN 'year_above_max' WHEN type <> '' AND type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'type_not_allowed'
  WHEN language <> '' AND language NOT IN ('en') THEN 'language_not_allowed' END"""


@query(f"WITH {A.SQL_WORKS} SELECT key, {SQL_REASON} AS reason FROM works")
def eligibility_reasons(spark, d):
    return A.works(spark, d).select("key", eligibility.reason(CRITERIA).alias("reason"))


@query(
    f"""WITH {A.SQL_WORKS} SELECT key, CASE WHEN coalesce(trim(title), '') = '' THEN 'no_title' WHEN is_retracted THEN 'retracted' WHEN year IS NULL THEN 'no_year' WHEN year < 1975 THEN 'year_below_min'
    WHEN coalesce(type, '') = '' THEN 'no_type' WHEN type NOT IN ('ECONOMY') THEN 'type_not_allowed' WHEN coalesce(language, '') = '' THEN 'no_language' WHEN language NOT IN ('en') THEN 'language_not_allowed' END AS reason FROM works"""
)
def strict_eligibility(spark, d):
    return A.works(spark, d).select("key", eligibility.reason(STRICT).alias("reason"))


@query(
    f"""WITH {A.SQL_WORKS}, m AS (SELECT *, {SQL_REASON} AS reason FROM works)
    SELECT reason, coalesce(CASE WHEN reason LIKE '%type%' THEN type WHEN reason LIKE '%language%' THEN language WHEN reason LIKE '%year%' THEN year::VARCHAR END, '(none)') AS value,
    count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM works), 6) AS share FROM m WHERE reason IS NOT NULL GROUP BY 1, 2"""
)
def rejection_report(spark, d):
    return longs(eligibility.rejection_report(A.works(spark, d).withColumn("reason", eligibility.reason(CRITERIA))))


@query("SELECT printf('d:%08d', doc_id) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fresh_candidates(spark, d):
    return eligibility.fresh(A.text_works(spark, d), A.decisions(spark, d)).select("key")


# --- entity resolution -------------------------------------------------------------------------------------------


def records(spark, d) -> DataFrame:
    """Every fourth record has no DOI, every seventh no author, so that all tiers come up."""
    t = A.text_works(spark, d)
    return t.select(
        "key",
        S.normalize_title(F.col("title")).alias("title_norm"),
        "year",
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("author"), F.translate(S.normalize_surname(F.col("surname_raw")), "", ""))).alias("surname"),
        F.when(F.col("doc_id") % 4 != 0, F.lit(None)).otherwise(S.normalize_doi(F.col("doi_raw"))).alias("doi"),
    )


SQL_RECORDS = f"""{A.SQL_TEXT},
rec AS (SELECT key, title_norm, year, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'author' || surname END AS surname, CASE WHEN doc_id % 4 = 0 THEN doi END AS doi FROM tn),
blk AS (SELECT DISTINCT key, unnest([substr(title_norm, 1, 12) || '|' || (year // 2)::VARCHAR, substr(title_norm, 1, 12) || '|' || ((year + 1) // 2)::VARCHAR]) AS block FROM rec),
cand AS (SELECT DISTINCT x.key AS a, y.key AS b FROM blk x JOIN blk y ON x.block = y.block AND x.key < y.key),
pairs AS (SELECT a, b, x.title_norm AS ta, y.title_norm AS tb, x.year AS ya, y.year AS yb, x.surname AS sa, y.surname AS sb, x.doi AS da, y.doi AS db
  FROM cand JOIN rec x ON x.key = a JOIN rec y ON y.key = b),
marked AS (SELECT *, abs(ya - yb) <= 1 AND sa <> '' AND sb <> '' AND sa = sb AS near FROM pairs
  WHERE ta <> '' AND tb <> '' AND NOT coalesce(da <> db, false)),
star AS (SELECT doi, min(key) AS a FROM rec WHERE doi <> '' GROUP BY doi HAVING count(*) > 1),
t1 AS (SELECT s.a, r.key AS b FROM rec r JOIN star s ON s.doi = r.doi WHERE r.key <> s.a),
tiers AS (SELECT a, b, CASE WHEN ta = tb AND near THEN 'T2' WHEN near THEN 'T3' WHEN ta = tb AND ya = yb AND (sa = '' OR sb = '') THEN 'T4' END AS tier,
  CASE WHEN ta <> tb THEN jaro_winkler_similarity(ta, tb) ELSE 1.0 END AS score FROM marked),
hits AS (SELECT a, b, 'T1' AS tier, NULL::DOUBLE AS score FROM t1 UNION ALL
  SELECT a, b, tier, score FROM tiers WHERE tier IS NOT NULL AND (tier <> 'T3' OR score >= 0.95) AND (a, b) NOT IN (SELECT (a, b) FROM t1))"""
SQL_CLUSTERS = f"""{SQL_RECORDS}, und AS (SELECT a, b FROM hits UNION SELECT b, a FROM hits),
walk(key, other) AS (SELECT a, a FROM und UNION SELECT w.key, u.b FROM walk w JOIN und u ON u.a = w.other),
lab AS (SELECT key, min(other) AS cluster FROM walk GROUP BY key),
sized AS (SELECT key, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM lab),
res AS (SELECT key, cluster, size, size > 8 AS suspicious, CASE WHEN size > 8 THEN key ELSE cluster END AS rep FROM sized)"""


@query(f"WITH {SQL_RECORDS} SELECT a, b FROM t1")
def dedup_exact_doi(spark, d):
    return resolve.doi_pairs(records(spark, d)).select("a", "b")


def _tier(name: str) -> Query:
    def run(spark, d):
        return resolve.matches(records(spark, d), tier=name).select("a", "b", r6("score").alias("score"))

    run.__name__ = f"dedup_pairs_{name.lower()}"
    return run


for _name in ("T2", "T3", "T4"):
    query(f"WITH {SQL_RECORDS} SELECT a, b, round(score, 6) AS score FROM hits WHERE tier = '{_name}'")(_tier(_name))


@query(f"WITH RECURSIVE {SQL_CLUSTERS} SELECT key, rep, size::BIGINT AS size, suspicious FROM res")
def dedup_clusters(spark, d):
    return longs(resolve.labelled(records(spark, d)).select("key", "rep", "size", "suspicious"))


@query(f"WITH RECURSIVE {SQL_CLUSTERS} SELECT cluster, count(*)::BIGINT AS size FROM res WHERE suspicious GROUP BY cluster")
def dedup_oversize(spark, d):
    return resolve.labelled(records(spark, d)).where("suspicious").groupBy("cluster").agg(F.count("*").alias("size"))


@query(
    f"""WITH RECURSIVE {SQL_CLUSTERS}, ok AS (SELECT * FROM res WHERE NOT suspicious),
    inside AS (SELECT o.rep, h.* FROM hits h JOIN ok o ON o.key = h.a),
    best AS (SELECT rep, min(tier) AS tier, arg_min({{'s': score}}, {{'tier': tier, 'a': a, 'b': b}}).s AS score FROM inside GROUP BY rep)
    SELECT o.rep, o.members::BIGINT AS members, b.tier, round(b.score, 6) AS score FROM (SELECT rep, count(*) AS members FROM ok GROUP BY rep) o JOIN best b ON b.rep = o.rep"""
)
def merge_events(spark, d):
    r = records(spark, d)
    labels = durable(resolve.labelled(r))
    return longs(resolve.merge_events(labels, resolve.matches_within(r, labels)))


@query(
    f"""WITH RECURSIVE {SQL_CLUSTERS}, w AS (SELECT tw.key, coalesce(r.rep, tw.key) AS rep, CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a' END AS provider, title, year, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS lang FROM tw LEFT JOIN res r ON r.key = tw.key)
    SELECT rep AS key, arg_min(title, (provider, key)) AS title, arg_min(year, (provider, key))::BIGINT AS year, arg_min(lang, (provider, key)) FILTER (lang <> '') AS language,
    array_to_string(list_sort(list(DISTINCT provider)), '|') AS providers FROM w GROUP BY rep"""
)
def merge_records(spark, d):
    t = A.text_works(spark, d)
    provider = F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a")
    prov = F.struct(provider.alias("provider"), F.lit("backward").alias("direction"), F.lit(None).cast("string").alias("parent_key"), F.lit(1).alias("iteration"), F.lit("").alias("retrieved_at"), F.lit("").alias("response_hash"))
    w = t.select("key", "title", "year", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("language"), F.lit(False).alias("is_retracted"), F.lit(False).alias("unresolved"), F.create_map(F.lit("x"), F.col("key")).alias("source_ids"), F.array(prov).alias("provenance"))
    labels = resolve.labelled(records(spark, d))
    merged = resolve.merge(w, labels, ("a", "b"))
    return longs(merged.select("key", "title", "year", "language", F.array_join(F.array_sort(F.array_distinct(F.transform("provenance", lambda p: p["provider"]))), "|").alias("providers")))


@query(f"WITH {SQL_RECORDS} SELECT a, b, (CASE WHEN ta <> tb THEN 1 ELSE 0 END + CASE WHEN ya <> yb THEN 1 ELSE 0 END)::BIGINT AS conflicts FROM pairs JOIN t1 USING (a, b)")
def field_conflicts(spark, d):
    r = records(spark, d)
    one = resolve.doi_pairs(r).select("a", "b")
    rec = r.select("key", S.blocking_keys(F.col("title_norm"), F.col("year")).alias("blocks"), F.struct(F.col("title_norm").alias("title"), "doi", "year", F.lit("").alias("venue"), F.lit("").alias("type"), F.lit("").alias("language")).alias("rec"))
    side = lambda c, x: rec.select(F.col("key").alias(c), F.col("rec").alias(x), F.col("blocks").alias(f"{c}_blocks"))
    # a pair of T1 is looked at by itself, so that no block's pairs are made
    both = one.join(side("a", "x"), "a").join(side("b", "y"), "b").where(F.arrays_overlap("a_blocks", "b_blocks"))
    return both.select("a", "b", F.size(S.field_conflicts("x", "y")).cast("long").alias("conflicts"))


# --- ranking -----------------------------------------------------------------------------------------------------


def _terms(spark, d) -> DataFrame:
    t = A.text_works(spark, d)
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: F.length(x) > 3)
    return t.select("key", words.alias("terms"))


SQL_TERMS = """dec AS (SELECT printf('d:%08d', doc_id) AS key, max(quality) AS q FROM labels GROUP BY doc_id),
docs AS (SELECT printf('d:%08d', doc_id) AS key, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 3) AS terms FROM documents),
inc AS (SELECT * FROM docs WHERE key IN (SELECT key FROM dec WHERE q = 1)), cand AS (SELECT * FROM docs WHERE key NOT IN (SELECT key FROM dec)),
tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(terms) AS term FROM cand) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qw AS (SELECT term, count(*) AS qw FROM (SELECT unnest(terms) AS term FROM inc) GROUP BY term),
tot AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM cand),
bm AS (SELECT tf.key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c.terms) / avgdl)) * ln(1 + qw)) AS score
  FROM tf JOIN df USING (term) JOIN qw USING (term) JOIN cand c ON c.key = tf.key CROSS JOIN tot GROUP BY tf.key),
bms AS (SELECT c.key, coalesce(score, 0.0) AS score FROM cand c LEFT JOIN bm ON bm.key = c.key)"""


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    docs, dec = _terms(spark, d), A.decisions(spark, d)
    return docs.join(dec.where("decision = 'include'"), "key", "left_semi"), docs.join(dec, "key", "left_anti")


@query(f"WITH {SQL_TERMS} SELECT key, round(score, 5) AS score FROM bms")
def bm25_rank(spark, d):
    inc, cand = _split(spark, d)
    return rank.bm25(inc, cand).select("key", F.round("score", 5).alias("score"))


@query(f"WITH {SQL_TERMS} SELECT key, round(score, 5) AS score, row_number() OVER (ORDER BY round(score, 8) DESC, key)::BIGINT AS rank FROM bms QUALIFY rank <= 50")
def topk_candidates(spark, d):
    inc, cand = _split(spark, d)
    return rank.top(rank.bm25(inc, cand), 50).select("key", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


SQL_NETWORK = f"""{A.SQL_REACH}, inc AS (SELECT key FROM found WHERE included), cand AS (SELECT key FROM found WHERE NOT included),
prov AS (SELECT DISTINCT e.dst AS key, e.src AS parent FROM edges e JOIN inc p ON p.key = e.src JOIN found k ON k.key = e.dst),
np AS (SELECT p.key, count(*) AS n_parents FROM prov p JOIN cand USING (key) GROUP BY p.key),
co AS (SELECT a.key, count(*) AS cocitation FROM prov a JOIN cand c ON c.key = a.key JOIN prov b ON a.parent = b.parent JOIN inc i ON i.key = b.key WHERE a.key <> b.key GROUP BY a.key),
feat AS (SELECT c.key, coalesce(n_parents, 0)::BIGINT AS n_parents, coalesce(cocitation, 0)::BIGINT AS cocitation, coalesce(n_parents, 0)::BIGINT AS coupling, 0::BIGINT AS both_directions
  FROM cand c LEFT JOIN np ON np.key = c.key LEFT JOIN co ON co.key = c.key),
ends AS (SELECT min(n_parents) AS lp, max(n_parents) AS hp, min(cocitation) AS lc, max(cocitation) AS hc FROM feat),
net AS (SELECT key, 0.65 * coalesce((n_parents - lp) / nullif(hp - lp, 0), 0) + 0.25 * coalesce((cocitation - lc) / nullif(hc - lc, 0), 0) AS score FROM feat CROSS JOIN ends)"""


def _network(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = crawl(spark, d)
    return expand.provenance(found, A.edges(spark, d)), found.where("not included"), found.where("included")


@query(f"WITH RECURSIVE {SQL_NETWORK} SELECT * FROM feat")
def network_features(spark, d):
    return longs(rank.network_features(*_network(spark, d)))


@query(f"WITH RECURSIVE {SQL_NETWORK} SELECT key, round(score, 6) AS score FROM net")
def network_rank(spark, d):
    return longs(rank.network_score(rank.network_features(*_network(spark, d))))


SQL_CENTROID = """unit AS (SELECT vec_id AS key, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
dims AS (SELECT key, label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM unit), cen AS (SELECT i, avg(x) AS c FROM dims WHERE label = 0 GROUP BY i),
cs AS (SELECT key, sum(x * c) / (SELECT sqrt(sum(c * c)) FROM cen) AS score FROM dims JOIN cen USING (i) GROUP BY key)"""


@query(f"WITH {SQL_CENTROID} SELECT key, round(score, 6) AS score FROM cs")
def embedding_centroid_rank(spark, d):
    v = A.vectors(spark, d)
    return longs(rank.centroid_score(v, v.where("label = 0")))


@query(f"WITH {SQL_CENTROID}, nul AS (SELECT key, 0.0 AS score FROM cs), ra AS (SELECT key, row_number() OVER (ORDER BY round(score, 8) DESC, key) AS r FROM cs), rb AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS r FROM nul) SELECT key, round(1.0 / (60 + ra.r) + 1.0 / (60 + rb.r), 6) AS score FROM ra JOIN rb USING (key)")
def rrf_fusion(spark, d):
    v = A.vectors(spark, d)
    return longs(rank.fuse({"centroid": rank.centroid_score(v, v.where("label = 0")), "null": rank.null_score(v)}))


# --- estimates ---------------------------------------------------------------------------------------------------

#: The providers that are the capture arms a, b and c.
ARMS = ("A", "N", "R")


def histories(spark, d) -> DataFrame:
    found, e = crawl(spark, d), A.edges(spark, d)
    arms = {n: F.col("provider") == p for n, p in zip("abc", ARMS, strict=True)}
    return estimate.capture_histories(expand.provenance(found, e), found.where("included"), arms)


@query(f"WITH RECURSIVE {A.SQL_CAPTURES} SELECT * FROM captures")
def capture_histories(spark, d):
    return histories(spark, d)


@query(f"WITH RECURSIVE {A.SQL_CAPTURES}, every AS (SELECT lpad(bin(x), 3, '0') AS pattern FROM range(1, 8) t(x)), seen AS (SELECT a::INT::VARCHAR || b::INT::VARCHAR || c::INT::VARCHAR AS pattern, count(*) AS n FROM captures GROUP BY 1) SELECT pattern, coalesce(n, 0)::BIGINT AS n FROM every LEFT JOIN seen USING (pattern)")
def capture_cells(spark, d):
    return longs(estimate.cells(histories(spark, d), list("abc")))


SQL_OVERLAP = f"{A.SQL_CAPTURES}, ov AS (SELECT count(*) FILTER (a)::BIGINT AS n1, count(*) FILTER (b)::BIGINT AS n2, count(*) FILTER (a AND b)::BIGINT AS m, count(*)::BIGINT AS n_observed FROM captures)"
SQL_CHAPMAN = """ch AS (SELECT *, (n1 + 1) * (n2 + 1) / (m + 1) - 1 AS raw, sqrt((n1 + 1) * (n2 + 1) * (n1 - m) * (n2 - m) / ((m + 1) * (m + 1) * (m + 2))) AS s,
  CASE WHEN m < 3 THEN 'overlap_below_minimum' WHEN n1 <= 0 OR n2 <= 0 THEN 'empty_arm' WHEN (n1 + 1) * (n2 + 1) / (m + 1) - 1 <= n_observed THEN 'nested_arms' END AS reason FROM ov),
cc AS (SELECT *, greatest(n_observed, raw - 1.96 * s) AS lo, greatest(greatest(n_observed, raw - 1.96 * s), raw + 1.96 * s) AS hi, reason IS NULL AS estimable FROM ch)"""
SQL_CHAPMAN_OUT = """SELECT n1, n2, m, n_observed, reason, estimable, CASE WHEN estimable THEN round(raw, 6) END AS n_hat, CASE WHEN estimable THEN round(s, 6) END AS se,
  CASE WHEN estimable THEN round(lo, 6) END AS n_hat_low, CASE WHEN estimable THEN round(hi, 6) END AS n_hat_high, CASE WHEN estimable THEN round(least(1.0, n_observed / raw), 6) END AS recall,
  CASE WHEN estimable THEN round(least(1.0, n_observed / hi), 6) END AS recall_low, CASE WHEN estimable THEN round(least(1.0, n_observed / lo), 6) END AS recall_high FROM cc"""


@query(f"WITH RECURSIVE {SQL_OVERLAP} SELECT * FROM ov")
def arm_overlap(spark, d):
    return estimate.overlap(histories(spark, d), list("abc"))


@query(f"WITH RECURSIVE {SQL_OVERLAP} SELECT *, CASE WHEN m > 0 THEN round(n1 * n2 / m, 6) END AS n_hat FROM ov")
def lincoln_petersen(spark, d):
    return longs(estimate.lincoln_petersen(estimate.overlap(histories(spark, d), list("abc"))))


@query(f"WITH RECURSIVE {SQL_OVERLAP}, {SQL_CHAPMAN} {SQL_CHAPMAN_OUT}")
def chapman_estimate(spark, d):
    return longs(estimate.chapman(estimate.overlap(histories(spark, d), list("abc"))))


CASES = "ov AS (SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, m::BIGINT AS m, seen::BIGINT AS n_observed FROM (VALUES (60, 50, 30, 80), (10, 10, 2, 18), (0, 10, 0, 10), (337, 83, 83, 337), (153, 79, 71, 161), (323, 526, 264, 585), (60, 55, 20, 95)) t(n1, n2, m, seen))"


@query(f"WITH {CASES}, {SQL_CHAPMAN} {SQL_CHAPMAN_OUT}")
def chapman_refusal(spark, d):
    rows = [(60, 50, 30, 80), (10, 10, 2, 18), (0, 10, 0, 10), (337, 83, 83, 337), (153, 79, 71, 161), (323, 526, 264, 585), (60, 55, 20, 95)]
    return longs(estimate.chapman(spark.createDataFrame(rows, "n1 long, n2 long, m long, n_observed long")))


@query(
    f"""WITH RECURSIVE {A.SQL_CAPTURES}, fr AS (SELECT count(*)::DOUBLE AS s, count(*) FILTER (a::INT + b::INT + c::INT = 1)::DOUBLE AS f1, count(*) FILTER (a::INT + b::INT + c::INT = 2)::DOUBLE AS f2 FROM captures),
    e AS (SELECT *, s + f1 * f1 / (2 * f2) AS n, f2 * (0.5 * (f1 / f2) ** 2 + (f1 / f2) ** 3 + 0.25 * (f1 / f2) ** 4) AS v FROM fr),
    k AS (SELECT *, exp(1.96 * sqrt(ln(1 + v / ((n - s) * (n - s))))) AS c FROM e)
    SELECT s::BIGINT AS s_obs, f1::BIGINT AS f1, f2::BIGINT AS f2, round(n, 4) AS n_hat, round(s + (n - s) / c, 4) AS n_hat_low, round(s + (n - s) * c, 4) AS n_hat_high, round(s / n, 6) AS recall FROM k"""
)
def chao1_estimate(spark, d):
    x = estimate.chao1(estimate.frequencies(histories(spark, d), list("abc")))
    return x.select("s_obs", "f1", "f2", *(F.round(c, 4).alias(c) for c in ("n_hat", "n_hat_low", "n_hat_high")), r6("recall").alias("recall"))


@query(
    f"""WITH RECURSIVE {A.SQL_CAPTURES}, tabled AS (SELECT list_transform(range(1, 8), lambda p: len(list_filter(l, lambda x: x = p)))::DOUBLE[] AS y FROM (SELECT list(4 * a::INT + 2 * b::INT + c::INT) AS l FROM captures)),
    {A.sql_loglinear("tabled", "")} SELECT n_observed, estimable, reason, round(n_hat, 4) AS n_hat, round(recall, 6) AS recall, terms, round(aic, 4) AS aic FROM chosen"""
)
def loglinear_estimate(spark, d):
    tables = loglinear.table_of(estimate.cells(histories(spark, d), list("abc")), 3)
    out = loglinear.select(tables, 3)
    return out.withColumns({c: F.round(c, p) for c, p in (("n_hat", 4), ("recall", 6), ("aic", 4))})


def _odds_sql() -> str:
    parts = [f"SELECT '{x}' AS first_arm, '{y}' AS second_arm, count(*) FILTER ({z} AND {x} AND {y})::DOUBLE AS a, count(*) FILTER ({z} AND {x} AND NOT {y})::DOUBLE AS b, count(*) FILTER ({z} AND NOT {x} AND {y})::DOUBLE AS c, count(*) FILTER ({z} AND NOT {x} AND NOT {y})::DOUBLE AS d FROM captures" for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))]
    return f"""WITH RECURSIVE {A.SQL_CAPTURES}, t AS ({' UNION ALL '.join(parts)}), u AS (SELECT *, a + b + c + d AS n FROM t)
    SELECT first_arm, second_arm, a, b, c, d, n, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio,
    round(coalesce(n * pow(greatest(abs(a * d - b * c) - n / 2, 0), 2) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 0), 6) AS chi_square FROM u WHERE n >= 10"""


@query(_odds_sql())
def conditional_odds(spark, d):
    return longs(estimate.odds(histories(spark, d), list("abc")))


SQL_STRATA = f"""{A.SQL_CAPTURES}, {A.SQL_WORKS}, j AS (SELECT w.*, a::INT + b::INT + c::INT AS n_arms FROM works w JOIN captures USING (key)),
med AS (SELECT list_sort(list(year))[len(list(year)) // 2 + 1] AS y FROM j WHERE year IS NOT NULL),
st AS (SELECT 'year' AS dimension, CASE WHEN year < (SELECT y FROM med) THEN 'older' ELSE 'newer' END AS stratum, n_arms FROM j WHERE year IS NOT NULL UNION ALL
  SELECT 'language', CASE WHEN coalesce(language, '') = '' THEN 'unknown' WHEN language = 'en' THEN 'en' ELSE 'non-en' END, n_arms FROM j UNION ALL
  SELECT 'type', coalesce(nullif(type, ''), 'unknown'), n_arms FROM j),
strata AS (SELECT dimension, stratum, count(*)::BIGINT AS n, avg(n_arms) AS mean_arms FROM st GROUP BY ALL)"""


def _strata(spark, d) -> DataFrame:
    h = histories(spark, d)
    n = F.expr("cast(a as int) + cast(b as int) + cast(c as int)")
    return estimate.strata(A.works(spark, d), h.select("key", n.alias("n_arms")))


@query(f"WITH RECURSIVE {SQL_STRATA} SELECT dimension, stratum, n, round(mean_arms, 6) AS mean_arms FROM strata")
def strata_means(spark, d):
    return longs(_strata(spark, d))


@query(f"WITH RECURSIVE {SQL_STRATA} SELECT dimension, round(min(mean_arms), 6) AS lowest, round(max(mean_arms), 6) AS highest, (max(mean_arms) - min(mean_arms)) / max(mean_arms) > 0.25 AS flagged FROM strata GROUP BY dimension")
def heterogeneity_strata(spark, d):
    return longs(estimate.heterogeneity(_strata(spark, d)))


@query("SELECT s_nationkey AS set_name, count(DISTINCT l_partkey)::BIGINT AS n_members FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY' GROUP BY 1")
def membership_arm(spark, d):
    """Gold works that each membership set (a nation's suppliers) holds."""
    sets = A.table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("key")).distinct()
    of = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("set_name"))
    held = sets.join(of, "l_suppkey").join(A.gold(spark, d), "key", "left_semi")
    return held.groupBy("set_name").agg(F.count_distinct("key").alias("n_members"))


@query("SELECT event_type AS provider, min(strftime(ts, '%Y-%m-%d')) AS first_day, max(strftime(ts, '%Y-%m-%d')) AS last_day, min(strftime(ts, '%Y-%m-%d')) <> max(strftime(ts, '%Y-%m-%d')) AS differs FROM events GROUP BY 1")
def closure_window(spark, d):
    """First and last retrieval day of each provider's responses."""
    return verify.closure_window(A.table(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("ts").alias("at")))


def _split_seeds(spark, d) -> DataFrame:
    """The ten smallest gold keys dealt to two crawls."""
    k = A.gold(spark, d).orderBy("key").limit(10).withColumn("r", F.row_number().over(Window.orderBy("key")))
    return k.select(F.when(F.col("r") % 2 == 1, "x").otherwise("y").alias("trial"), "key")


@query(
    f"""WITH RECURSIVE {A.SQL_EDGES}, {A.SQL_GOLD}, starts AS (SELECT CASE WHEN row_number() OVER (ORDER BY key) % 2 = 1 THEN 'x' ELSE 'y' END AS trial, key FROM (SELECT key FROM gold ORDER BY key LIMIT 10)),
    reach(trial, key, n) AS (SELECT trial, key, 0 FROM starts UNION SELECT r.trial, e.dst, r.n + 1 FROM reach r JOIN gold g ON g.key = r.key JOIN edges e ON e.src = r.key WHERE r.n < 25),
    cap AS (SELECT key, bool_or(trial = 'x') AS a, bool_or(trial = 'y') AS b FROM reach WHERE key IN (SELECT key FROM gold) GROUP BY key),
    ov AS (SELECT count(*) FILTER (a)::BIGINT AS n1, count(*) FILTER (b)::BIGINT AS n2, count(*) FILTER (a AND b)::BIGINT AS m, count(*)::BIGINT AS n_observed FROM cap), {SQL_CHAPMAN} {SQL_CHAPMAN_OUT}"""
)
def seed_split_estimate(spark, d):
    """Two crawls from split seeds as capture arms."""
    found = expand.snowball(A.edges(spark, d), _split_seeds(spark, d), A.gold(spark, d))
    return longs(estimate.chapman(estimate.overlap(estimate.trial_captures(found, ["x", "y"]), ["x", "y"])))


# --- stopping ----------------------------------------------------------------------------------------------------


def run_history(spark, d) -> DataFrame:
    return expand.history(crawl(spark, d))


@query(f"WITH RECURSIVE {A.SQL_HISTORY} SELECT n::BIGINT AS n, n_screened, n_included, n_screened - n_included AS n_excluded, cumulative_screened, cumulative_included FROM history")
def iteration_history(spark, d):
    return longs(run_history(spark, d).select("n", "n_screened", "n_included", (F.col("n_screened") - F.col("n_included")).alias("n_excluded"), "cumulative_screened", "cumulative_included"))


SQL_RULES = f"""{A.SQL_HISTORY}, rules AS (
  SELECT n, 'marginal_yield' AS rule, count(*) OVER w >= 2 AND max(yield_rate) OVER w < 0.08 AS triggered, yield_rate AS value FROM history WINDOW w AS (ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) UNION ALL
  SELECT n, 'budget', cumulative_screened >= 1500, cumulative_screened FROM history UNION ALL
  SELECT n, 'exhaustion', frontier_size = 0, frontier_size FROM history)"""


def _rules(spark, d) -> DataFrame:
    h = run_history(spark, d)
    return stopping.marginal_yield(h, 0.08).union(stopping.budget(h, 1500)).union(stopping.exhaustion(h))


def _rule(name: str) -> Query:
    def run(spark, d):
        return longs(_rules(spark, d).where(F.col("rule") == name).select("n", "triggered", "value"))

    run.__name__ = f"rule_{name}"
    return run


for _name in ("marginal_yield", "budget", "exhaustion"):
    query(f"WITH RECURSIVE {SQL_RULES} SELECT n::BIGINT AS n, triggered, round(value, 6) AS value FROM rules WHERE rule = '{_name}'")(_rule(_name))


@query(
    f"""WITH RECURSIVE {SQL_RULES}, s AS (SELECT n, max(CASE WHEN triggered THEN 1 ELSE 0 END) = 1 AS stop, min(CASE WHEN triggered THEN CASE rule WHEN 'marginal_yield' THEN 0 WHEN 'budget' THEN 1 ELSE 2 END END) AS k FROM rules GROUP BY n)
    SELECT n::BIGINT AS n, stop, CASE k WHEN 0 THEN 'marginal_yield' WHEN 1 THEN 'budget' WHEN 2 THEN 'exhaustion' END AS stopped_by FROM s"""
)
def ruleset_decision(spark, d):
    return longs(stopping.rule_set(_rules(spark, d), ["marginal_yield", "budget", "exhaustion"]).drop("trial"))


@query(f"WITH RECURSIVE {A.SQL_HISTORY} SELECT n::BIGINT AS n, cumulative_screened || ' of 1500 records screened.' AS rationale FROM history")
def stop_rationale(spark, d):
    return longs(stopping.budget(run_history(spark, d), 1500).select("n", "rationale"))


SQL_TRAIL = f"""{A.SQL_CAPTURES}, inc2 AS (SELECT key, n FROM found WHERE included), ns AS (SELECT DISTINCT n FROM found WHERE n > 0),
cap AS (SELECT ns.n, e.dst AS key, bool_or(provider = 'A') AS a, bool_or(provider = 'N') AS b, bool_or(provider = 'R') AS c FROM ns JOIN inc2 y ON y.n <= ns.n JOIN edges e ON e.dst = y.key JOIN inc2 x ON x.key = e.src AND x.n < ns.n GROUP BY ALL),
ov AS (SELECT n, count(*) FILTER (a)::BIGINT AS n1, count(*) FILTER (b)::BIGINT AS n2, count(*) FILTER (a AND b)::BIGINT AS m, count(*)::BIGINT AS n_observed FROM cap GROUP BY n), {SQL_CHAPMAN},
tr AS (SELECT n, estimable, CASE WHEN estimable THEN raw END AS n_hat, CASE WHEN estimable THEN least(1.0, n_observed / hi) END AS recall_low, CASE WHEN estimable THEN least(1.0, n_observed / raw) END AS recall FROM cc)"""


def _trail(spark, d) -> DataFrame:
    """The Chapman estimate as it stood after each round: all rounds in one aggregate, keyed by round."""
    found, e = crawl(spark, d), A.edges(spark, d)
    inc = found.where("included").select("key", F.col("n").alias("born"))
    ns = found.where("n > 0").select("n").distinct()
    ways = e.join(inc.select(F.col("key").alias("src"), F.col("born").alias("src_born")), "src").join(inc.withColumnRenamed("key", "dst"), "dst")
    alive = ways.join(F.broadcast(ns), (F.col("born") <= F.col("n")) & (F.col("src_born") < F.col("n")))
    caps = alive.groupBy("n", "dst").agg(*(F.bool_or(F.col("provider") == p).alias(x) for x, p in zip("abc", ARMS, strict=True)))
    counts = caps.groupBy("n").agg(F.count_if("a").alias("n1"), F.count_if("b").alias("n2"), F.count_if(F.col("a") & F.col("b")).alias("m"), F.count("*").alias("n_observed"))
    return estimate.chapman(counts).withColumn("trial", F.lit("t"))


@query(
    f"""WITH RECURSIVE {SQL_TRAIL}, good AS (SELECT n, abs(n_hat - lag(n_hat) OVER (ORDER BY n)) / lag(n_hat) OVER (ORDER BY n) AS step, row_number() OVER (ORDER BY n) AS points FROM tr WHERE estimable AND n_hat > 0),
    dr AS (SELECT n, points, max(step) OVER (ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS drift FROM good)
    SELECT tr.n::BIGINT AS n, coalesce(recall_low >= 0.6 AND points > 2 AND drift <= 0.05 AND estimable, false) AS triggered, round(recall_low, 6) AS value FROM tr LEFT JOIN dr ON dr.n = tr.n"""
)
def rule_recall_stability(spark, d):
    return longs(stopping.recall_stability(_trail(spark, d), tau=0.6).select("n", "triggered", "value"))


@query()
def asymptote_fit(spark, d):
    """No SQL: a bounded two-parameter fit for each round."""
    return longs(stopping.asymptotic_coverage(run_history(spark, d)).select("n", "triggered", r6("value").alias("value")))


# --- simulation --------------------------------------------------------------------------------------------------


def gold_cited(gold: DataFrame, edges: DataFrame) -> DataFrame:
    return gold.join(edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("cited_by")), "key", "left")


def _gold_cited(spark, d) -> DataFrame:
    return gold_cited(A.gold(spark, d), A.edges(spark, d))


SQL_CITED = f"{A.SQL_EDGES}, {A.SQL_GOLD}, cited AS (SELECT g.key, g.year, n.cited_by FROM gold g LEFT JOIN (SELECT dst, count(*) AS cited_by FROM edges GROUP BY dst) n ON n.dst = g.key)"


@query(f"WITH {SQL_CITED} SELECT key FROM cited ORDER BY coalesce(cited_by, 0) DESC, key LIMIT 5")
def seed_most_cited(spark, d):
    return simulate.select_seeds(_gold_cited(spark, d), "most_cited", 5)


@query(f"WITH {SQL_CITED} SELECT key FROM cited ORDER BY coalesce(year, 9999), key LIMIT 5")
def seed_oldest(spark, d):
    return simulate.select_seeds(_gold_cited(spark, d), "oldest", 5)


@query(f"WITH {SQL_CITED} SELECT key FROM cited ORDER BY md5('0|' || key), key LIMIT 5")
def seed_random(spark, d):
    return simulate.select_seeds(_gold_cited(spark, d), "random", 5)


SQL_CURVE = f"{A.SQL_HISTORY}, curve AS (SELECT *, least(1.0, cumulative_included / (SELECT count(*) FROM gold)) AS recall FROM history)"


def _curve(spark, d) -> tuple[DataFrame, int]:
    n = A.gold(spark, d).count()
    return simulate.recall_curve(run_history(spark, d), n), n


@query(f"WITH RECURSIVE {SQL_CURVE} SELECT n::BIGINT AS n, cumulative_screened, cumulative_included, round(recall, 6) AS recall FROM curve")
def recall_curve(spark, d):
    return longs(_curve(spark, d)[0].select("n", "cumulative_screened", "cumulative_included", "recall"))


@query(f"WITH RECURSIVE {SQL_CURVE} SELECT t.target, min(cumulative_screened) FILTER (recall >= t.target)::BIGINT AS screened FROM curve CROSS JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) t(target) GROUP BY t.target")
def screening_burden(spark, d):
    return longs(simulate.burden(_curve(spark, d)[0], [0.5, 0.8, 0.9]).drop("trial"))


@query(
    f"""WITH RECURSIVE {SQL_RULES}, curve AS (SELECT *, least(1.0, cumulative_included / (SELECT count(*) FROM gold)) AS recall FROM history),
    f AS (SELECT rule, min(n) FILTER (triggered) AS fired_at FROM rules GROUP BY rule), o AS (SELECT coalesce(min(n) FILTER (recall >= 0.8), max(n)) AS n FROM curve),
    x AS (SELECT f.rule, f.fired_at, o.n AS optimal_n, c.recall AS recall_at_stop, c.cumulative_screened - b.cumulative_screened AS excess, greatest(0, round_even((0.8 - c.recall) * (SELECT count(*) FROM gold), 0)) AS missed, b.cumulative_screened AS ob
      FROM f CROSS JOIN o LEFT JOIN curve c ON c.n = f.fired_at LEFT JOIN curve b ON b.n = o.n)
    SELECT rule, fired_at::BIGINT AS fired_at, optimal_n::BIGINT AS optimal_n, round(recall_at_stop, 6) AS recall_at_stop, (fired_at - optimal_n)::BIGINT AS overshoot, excess::BIGINT AS excess,
    CASE WHEN fired_at IS NOT NULL THEN missed::BIGINT END AS missed, CASE WHEN fired_at IS NOT NULL THEN round(CASE WHEN excess > 0 THEN excess / greatest(1, ob) ELSE missed / (SELECT count(*) FROM gold) END, 6) END AS regret FROM x"""
)
def stopping_outcomes(spark, d):
    curve, n = _curve(spark, d)
    return longs(simulate.outcomes(curve, stopping.first_fired(_rules(spark, d)), n, 0.8).drop("trial"))


@query(
    f"""WITH RECURSIVE {SQL_TRAIL}, p AS (SELECT recall AS e, (SELECT count(*) FROM found f WHERE f.included AND f.n <= tr.n) / (SELECT count(*) FROM gold) AS t FROM tr)
    SELECT round(avg(e - t), 6) AS bias, round(avg(abs(e - t)), 6) AS mae, round(sqrt(avg((e - t) * (e - t))), 6) AS rmse, round(avg((e > t)::INT), 6) AS overestimate_rate, count(*)::BIGINT AS n FROM p WHERE e IS NOT NULL"""
)
def calibration(spark, d):
    curve, _ = _curve(spark, d)
    pairs = _trail(spark, d).select("n", F.col("recall").alias("estimated")).join(curve.select("n", F.col("recall").alias("true")), "n")
    return longs(simulate.calibration(pairs))


@query(
    f"""WITH RECURSIVE {SQL_CITED}, starts AS ((SELECT 'most_cited/3/0' AS trial, key FROM cited ORDER BY coalesce(cited_by, 0) DESC, key LIMIT 3) UNION ALL (SELECT 'oldest/3/0', key FROM cited ORDER BY coalesce(year, 9999), key LIMIT 3)
      UNION ALL (SELECT 'random/3/0', key FROM cited ORDER BY md5('0|' || key), key LIMIT 3) UNION ALL (SELECT 'random/3/1', key FROM cited ORDER BY md5('1|' || key), key LIMIT 3)),
    reach(trial, key, n) AS (SELECT trial, key, 0 FROM starts UNION SELECT r.trial, e.dst, r.n + 1 FROM reach r JOIN gold g ON g.key = r.key JOIN edges e ON e.src = r.key WHERE r.n < 25),
    found AS (SELECT trial, key, min(n) AS n, key IN (SELECT key FROM gold) AS included FROM reach GROUP BY trial, key)
    SELECT trial, n::BIGINT AS n, count(*)::BIGINT AS n_screened, count(*) FILTER (included)::BIGINT AS n_included FROM found WHERE n > 0 GROUP BY trial, n"""
)
def multi_trial_benchmark(spark, d):
    h = simulate.benchmark(A.edges(spark, d), _gold_cited(spark, d), ["most_cited", "oldest", "random"], [3], 2)
    return longs(h.select("trial", "n", "n_screened", "n_included"))


@query()
def synthetic_citation_graph(spark, d):
    """No SQL: a graph drawn by hash; counts of works, edges and gold, and that no work cites a later one."""
    works, edges, gold = simulate.synthetic_graph(spark)
    back = edges.where("src <= dst").count()
    return works.agg(F.count("*").alias("works")).join(edges.agg(F.count("*").alias("edges"))).join(gold.agg(F.count("*").alias("gold"))).withColumn("cycles", F.lit(back).cast("long"))


# --- agreement and screening statistics --------------------------------------------------------------------------

SQL_BASIS = f"{A.SQL_SCORES}, basis AS (SELECT * FROM scores WHERE key IN (SELECT key FROM scores WHERE score IS NOT NULL GROUP BY key HAVING count(DISTINCT rater) = 3))"


@query(f"WITH {SQL_BASIS} SELECT rater, count(*)::BIGINT AS n, round(avg(score), 6) AS mean FROM basis GROUP BY rater")
def common_basis(spark, d):
    return longs(stats.common_basis(A.scores(spark, d)).groupBy("rater").agg(F.count("*").alias("n"), F.avg("score").alias("mean")))


@query(
    f"""WITH {SQL_BASIS}, g AS (SELECT avg(score) AS m, count(DISTINCT key) AS n, 3 AS k FROM basis), rm AS (SELECT avg(score) AS x FROM basis GROUP BY key), cm AS (SELECT avg(score) AS x FROM basis GROUP BY rater),
    ss AS (SELECT (SELECT sum((x - m) ** 2) FROM rm) * k AS r, (SELECT sum((x - m) ** 2) FROM cm) * n AS c, (SELECT sum((score - m) ** 2) FROM basis) AS t, n, k FROM g),
    ms AS (SELECT n, k, r / (n - 1) AS r, c / (k - 1) AS c, (t - r - c) / ((n - 1) * (k - 1)) AS e FROM ss)
    SELECT n::BIGINT AS n, k::BIGINT AS k, round((r - e) / (r + (k - 1) * e + k * (c - e) / n), 6) AS icc FROM ms"""
)
def icc21(spark, d):
    return longs(stats.icc21(stats.common_basis(A.scores(spark, d))))


def _two(spark, d) -> DataFrame:
    s = A.scores(spark, d)
    x = s.where("rater = 'a1'").select("key", F.col("score").alias("x"), "actual")
    return x.join(s.where("rater = 'a2'").select("key", F.col("score").alias("y")), "key")


SQL_TWO = f"{A.SQL_SCORES}, two AS (SELECT x.key, x.score AS x, y.score AS y, x.actual FROM scores x JOIN scores y ON x.key = y.key AND x.rater = 'a1' AND y.rater = 'a2')"


@query(f"WITH {SQL_TWO}, o AS (SELECT count(*)::BIGINT AS n, avg(((x >= 6) = (y >= 6))::INT) AS po, avg((x >= 6)::INT) AS pa, avg((y >= 6)::INT) AS pb FROM two), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM o) SELECT n, round(po, 6) AS po, round((po - pe) / (1 - pe), 6) AS kappa FROM e")
def cohen_kappa(spark, d):
    return longs(stats.agreement(_two(spark, d).select((F.col("x") >= 6).alias("a"), (F.col("y") >= 6).alias("b"))).select("n", "po", "kappa"))


@query(f"WITH {SQL_TWO} SELECT round(2 * avg(((x >= 6) = (y >= 6))::INT) - 1, 6) AS pabak FROM two")
def pabak(spark, d):
    return longs(stats.agreement(_two(spark, d).select((F.col("x") >= 6).alias("a"), (F.col("y") >= 6).alias("b"))).select("pabak"))


@query(f"WITH {SQL_TWO} SELECT round(corr(x, y), 6) AS r, count(*)::BIGINT AS n FROM two")
def pearson(spark, d):
    return longs(stats.pearson(_two(spark, d)))


@query(f"WITH {SQL_TWO}, b AS (SELECT x, count(*) FILTER (actual) AS p, count(*) FILTER (NOT actual) AS q FROM two GROUP BY x), u AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS u FROM b) SELECT round(sum(u) / (sum(p) * sum(q)), 6) AS auc, sum(p)::BIGINT AS n_positive, sum(q)::BIGINT AS n_negative FROM u")
def auc_rank(spark, d):
    return longs(stats.auc(_two(spark, d).select(F.col("x").alias("score"), F.col("actual").alias("positive"))))


@query(f"WITH {A.SQL_SCORES}, m AS (SELECT key, avg(score) AS s FROM scores GROUP BY key) SELECT t.tau, count(*) FILTER (s >= t.tau)::BIGINT AS n_included, count(*)::BIGINT AS n, round(count(*) FILTER (s >= t.tau) / count(*), 6) AS share FROM m CROSS JOIN (VALUES (5.0::DOUBLE), (6.0::DOUBLE), (7.0::DOUBLE), (8.0::DOUBLE)) t(tau) GROUP BY t.tau")
def threshold_band(spark, d):
    return longs(stats.threshold_band(A.scores(spark, d), [5.0, 6.0, 7.0, 8.0]))


@query(f"WITH {SQL_TWO} SELECT count(*)::BIGINT AS n, count(*) FILTER ((x >= 7) <> (y >= 7))::BIGINT AS flips, count(*) FILTER ((x >= 7) <> (y >= 7) AND x BETWEEN 6 AND 8)::BIGINT AS boundary_flips, round(avg(abs(x - y)), 6) AS mae, round(coalesce((avg(((x >= 7) = (y >= 7))::INT) - avg((x >= 7)::INT) * avg((y >= 7)::INT) - (1 - avg((x >= 7)::INT)) * (1 - avg((y >= 7)::INT))) / nullif(1 - avg((x >= 7)::INT) * avg((y >= 7)::INT) - (1 - avg((x >= 7)::INT)) * (1 - avg((y >= 7)::INT)), 0), 1), 6) AS kappa FROM two")
def robustness(spark, d):
    s = A.scores(spark, d)
    return longs(stats.robustness(s.where("rater = 'a1'"), s.where("rater = 'a2'"), 7, 6, 8))


@query(f"WITH {SQL_TWO}, c AS (SELECT count(*) FILTER (x >= 6 AND actual)::BIGINT AS tp, count(*) FILTER (x >= 6 AND NOT actual)::BIGINT AS fp, count(*) FILTER (x < 6 AND actual)::BIGINT AS fn, count(*) FILTER (x < 6 AND NOT actual)::BIGINT AS tn FROM two) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c")
def confusion_matrix(spark, d):
    return longs(stats.confusion(_two(spark, d).select((F.col("x") >= 6).alias("predicted"), "actual")))


@query(f"WITH {A.SQL_SCORES} SELECT key, round(avg(score), 6) AS mean, max(score) - min(score) AS spread, count(*)::BIGINT AS n FROM scores WHERE score IS NOT NULL GROUP BY key")
def ensemble_spread(spark, d):
    return longs(stats.spread(A.scores(spark, d)))


@query(f"WITH {A.SQL_SCORES}, p AS (SELECT CASE WHEN substr(x.rater, 1, 1) = substr(y.rater, 1, 1) THEN 'within' ELSE 'between' END AS kind, abs(x.score - y.score) AS d FROM scores x JOIN scores y ON x.key = y.key AND x.rater < y.rater) SELECT kind, count(*)::BIGINT AS n_pairs, round(avg(d), 6) AS mae FROM p GROUP BY kind")
def family_agreement(spark, d):
    return longs(stats.family_agreement(A.scores(spark, d), F.substring("rater", 1, 1)))


@query()
def bootstrap_interval(spark, d):
    """No SQL: weights of the replicates are drawn by hash."""
    return longs(stats.bootstrap_mean(A.scores(spark, d).where("rater = 'a1'").select("key", F.col("score").alias("value"))))


SQL_STOP = ", ".join(f"'{w}'" for w in stats.SCREENING_STOPWORDS)
SQL_UNIT = f"""dec AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), docs AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '([a-z][a-z\\-]{{2,}})', 1) AS terms FROM documents),
    tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(terms) AS term FROM docs) WHERE term NOT IN ({SQL_STOP}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT key, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), sz AS (SELECT key, sqrt(sum(w * w)) AS s FROM raw GROUP BY key),
    unit AS (SELECT key, term, w / s AS w FROM raw JOIN sz USING (key)), cen AS (SELECT term, sum(w) AS c FROM unit JOIN dec ON doc_id = key AND q = 1 GROUP BY term)"""


def _screening_docs(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("key"), stats.screening_terms(F.col("text")).alias("terms"))
    core = A.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("key"))
    return docs, core


@query(f"WITH {SQL_UNIT} SELECT key, round(sum(w * c) / (SELECT sqrt(sum(c * c)) FROM cen), 6) AS similarity FROM unit JOIN cen USING (term) GROUP BY key")
def tfidf_centroid(spark, d):
    docs, core = _screening_docs(spark, d)
    return longs(stats.topic_similarity(stats.tfidf(docs), core).where("similarity > 0"))


@query(
    f"""WITH {SQL_UNIT}, o AS (SELECT key, sum(w * c) AS dot, sum(w * w) AS own FROM unit JOIN dec ON doc_id = key AND q = 1 JOIN cen USING (term) GROUP BY key), a AS (SELECT sum(c * c) AS cc FROM cen)
    SELECT doc_id AS key, round(coalesce((dot - own) / (sqrt(cc - 2 * dot + own) * sqrt(own)), 0), 6) AS similarity FROM dec LEFT JOIN o ON o.key = doc_id CROSS JOIN a WHERE q = 1"""
)
def seed_leave_one_out(spark, d):
    docs, core = _screening_docs(spark, d)
    return longs(stats.seed_leave_one_out(stats.tfidf(docs), core))


@query("SELECT event_id::VARCHAR AS key, (event_id % 12)::DOUBLE AS score FROM events WHERE event_id % 12 BETWEEN 1 AND 10")
def parse_score_replies(spark, d):
    e = A.table(spark, d, "events")
    reply = F.format_string('Here you are:\n[{"id": "%d", "score": %d}] done', "event_id", F.col("event_id") % 12)
    return stats.parse_scores(e.select(reply.alias("reply")))


@query(f"WITH {SQL_TWO}, r AS (SELECT row_number() OVER (ORDER BY x DESC, key) AS ra, row_number() OVER (ORDER BY y DESC, key) AS rb, least(250, greatest(20, count(*) OVER () // 10)) AS t FROM two) SELECT max(t)::BIGINT AS top_n, count(*) FILTER (ra <= t AND rb <= t)::BIGINT AS overlap FROM r")
def top_rank_agreement(spark, d):
    t = _two(spark, d)
    return longs(stats.top_agreement(t.select("key", F.col("x").alias("score")), t.select("key", F.col("y").alias("score"))))


@query(
    f"""WITH RECURSIVE {A.SQL_REACH}, cited AS (SELECT dst AS key, count(*) AS c FROM edges GROUP BY dst), pool AS (SELECT f.key, f.included, c, 1970 + p_size AS year, p_retailprice AS price FROM found f JOIN part ON p_partkey = f.key LEFT JOIN cited ON cited.key = f.key WHERE n > 0),
    rows_ AS (SELECT 'cited_by' AS name, coalesce(c, 0)::DOUBLE AS score, included FROM pool UNION ALL SELECT 'year', year::DOUBLE, included FROM pool UNION ALL SELECT 'price', price, included FROM pool),
    b AS (SELECT name, score, count(*) FILTER (included) AS p, count(*) FILTER (NOT included) AS q FROM rows_ GROUP BY name, score),
    u AS (SELECT name, p, q, p * (coalesce(sum(q) OVER (PARTITION BY name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS u FROM b)
    SELECT name, round(sum(u) / (sum(p) * sum(q)), 6) AS auc, sum(p)::BIGINT AS n_positive, sum(q)::BIGINT AS n_negative FROM u GROUP BY name"""
)
def bibliometric_auc(spark, d):
    """How well citations, year and price tell included works from the other found ones."""
    e = A.edges(spark, d)
    cited = e.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("c"))
    price = A.table(spark, d, "part").select(F.col("p_partkey").alias("key"), (1970 + F.col("p_size")).cast("double").alias("year"), F.col("p_retailprice").alias("price"))
    pool = crawl(spark, d).where("n > 0").join(price, "key").join(cited, "key", "left")
    each = F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("score")) for n, c in (("cited_by", F.coalesce("c", F.lit(0))), ("year", F.col("year")), ("price", F.col("price")))))
    return longs(stats.auc_by(pool.select(F.inline(each), F.col("included").alias("positive"))))


@query(f"WITH {A.SQL_SCORES} SELECT CASE WHEN actual THEN 'seed' ELSE 'control' END AS name, count(*)::BIGINT AS n, round(avg((score >= 6)::INT), 6) AS include_rate, round(avg(score), 6) AS mean FROM scores WHERE score IS NOT NULL GROUP BY 1")
def negative_control(spark, d):
    s = A.scores(spark, d)
    return longs(stats.control_groups(s.select(F.when(F.col("actual"), "seed").otherwise("control").alias("name"), "score"), 6))


# --- reports and verification ------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {A.SQL_REACH}, {A.SQL_WORKS}, m AS (SELECT w.*, CASE WHEN is_retracted THEN 1 ELSE 0 END AS bad FROM works w)
    SELECT count(*) FILTER (n > 0)::BIGINT AS identified, count(*) FILTER (n = 0)::BIGINT AS seeds, 0::BIGINT AS duplicates, (SELECT sum(bad) FROM m)::BIGINT AS ineligible,
    count(*) FILTER (n > 0)::BIGINT AS screened, count(*) FILTER (n > 0 AND included)::BIGINT AS included, count(*) FILTER (n > 0 AND NOT included)::BIGINT AS excluded FROM found"""
)
def prisma_counts(spark, d):
    found = crawl(spark, d)
    w = found.select("key", F.array(F.when(F.col("n") == 0, "seed").otherwise("backward")).alias("directions"))
    dec = found.select("key", F.when(F.col("included"), "include").otherwise("exclude").alias("decision"))
    bad = A.works(spark, d).where("is_retracted").groupBy("is_retracted").agg(F.count("*").alias("n"))
    return prisma.counts(w, dec, spark.createDataFrame([], "members long"), bad)


@query(f"WITH RECURSIVE {A.SQL_REACH} SELECT e.provider AS value, count(DISTINCT e.dst)::BIGINT AS n FROM edges e JOIN found p ON p.key = e.src AND p.included JOIN found k ON k.key = e.dst GROUP BY 1")
def prisma_by_provider(spark, d):
    return prisma.by_membership(expand.provenance(crawl(spark, d), A.edges(spark, d)), "provider")


@query("SELECT event_type AS event, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def audit_rollup(spark, d):
    e = A.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("event"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CASE q WHEN 1 THEN 'include' WHEN 0 THEN 'exclude' ELSE 'unscreened' END AS decision, count(*)::BIGINT AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY 1")
def status_rollup(spark, d):
    return prisma.status(A.text_works(spark, d), A.decisions(spark, d))


def _cache(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of orders as cached responses: every class of drift comes up by the key's remainder."""
    o = A.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    body = lambda title, ids, retracted, name: F.concat(F.lit('{"id":"'), name, F.lit('","is_retracted":'), retracted, F.lit(',"referenced_works":['), ids, F.lit('],"title":"'), title, F.lit('"}'))
    name = F.concat(F.lit("W"), k.cast("string"))
    two = F.lit('"R1","R2"')
    m = k % 8
    old = o.select(k.cast("string").alias("cache_key"), F.col("o_orderstatus").alias("provider"), body(F.lit("t"), two, F.lit("false"), name).alias("body"))
    fresh = body(
        F.when(m == 6, "u").otherwise("t"),
        F.when(m == 3, F.lit('"R1","R2","R3"')).when(m == 4, F.lit('"R1"')).when(m == 5, F.lit('"R1","R4"')).otherwise(two),
        F.when(m == 1, "true").otherwise("false"),
        F.when(m == 2, F.concat(F.lit("X"), k.cast("string"))).otherwise(name),
    )
    new = o.select(k.cast("string").alias("cache_key"), F.when(m == 7, 404).otherwise(200).alias("http_status"), F.when(m != 7, fresh).alias("body"))
    return old.withColumn("response_hash", S.response_hash(F.col("body"))), new


SQL_DRIFT = "dr AS (SELECT o_orderkey::VARCHAR AS cache_key, o_orderstatus AS provider, CASE o_orderkey % 8 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'retracted' WHEN 2 THEN 'merged' WHEN 3 THEN 'new_citing' WHEN 4 THEN 'lost_citing' WHEN 5 THEN 'new_citing' WHEN 6 THEN 'metadata_changed' ELSE 'deindexed' END AS class, CASE o_orderkey % 8 WHEN 3 THEN 'R3' WHEN 5 THEN 'R4' ELSE '' END AS added, CASE WHEN o_orderkey % 8 IN (4, 5) THEN 'R2' ELSE '' END AS removed, CASE o_orderkey % 8 WHEN 6 THEN 'title' ELSE '' END AS changed FROM orders)"


@query(f"WITH {SQL_DRIFT} SELECT * FROM dr")
def drift_classify(spark, d):
    x = verify.classify(*_cache(spark, d))
    return x.select("cache_key", "provider", "class", *(F.array_join(c, "|").alias(n) for c, n in (("added", "added"), ("removed", "removed"), ("changed_fields", "changed"))))


@query(f"WITH {SQL_DRIFT} SELECT provider, class, count(*)::BIGINT AS n FROM dr GROUP BY 1, 2 UNION ALL SELECT NULL, class, count(*)::BIGINT FROM dr GROUP BY 2")
def drift_counts(spark, d):
    return verify.drift_counts(verify.classify(*_cache(spark, d)))


@query("SELECT o_orderkey::VARCHAR AS cache_key, o_orderkey % 10 <> 0 AS key_ok, o_orderkey % 6 <> 0 AS body_ok FROM orders")
def cache_integrity(spark, d):
    """Entries of which some are spoilt: every tenth's name, every sixth's body."""
    k = F.col("o_orderkey")
    c = A.table(spark, d, "orders").select(
        k.alias("k"), F.lit("openalex").alias("provider"), F.lit("get").alias("method"), F.format_string('{"b":%d,"a":1}', k).alias("params"), F.format_string('{"y":%d,"x":[]}', k).alias("body")
    )
    c = c.withColumn("cache_key", S.request_key(F.col("provider"), F.col("method"), F.when(F.col("k") % 10 == 0, F.lit("{}")).otherwise(F.format_string('{"a":1,"b":%d}', "k"))))
    c = c.withColumn("response_hash", S.response_hash(F.when(F.col("k") % 6 == 0, F.lit("{}")).otherwise(F.format_string('{"x":[],"y":%d}', "k"))))
    return verify.integrity(c, "k").select(F.col("k").cast("string").alias("cache_key"), "key_ok", "body_ok")


# --- exports -----------------------------------------------------------------------------------------------------


def _work_rows(spark, d) -> DataFrame:
    """Parts as whole works, for the exports."""
    w = A.works(spark, d)
    none = F.lit(None).cast("string")
    author = F.struct(F.regexp_replace("venue", "[^A-Za-z]", "").alias("surname"), F.lit("X").alias("given"), none.alias("orcid"))
    p = F.struct(F.lit("a").alias("provider"), F.lit("backward").alias("direction"), F.lit("p").alias("parent_key"), F.lit(1).alias("iteration"), F.lit("").alias("retrieved_at"), F.lit("").alias("response_hash"))
    key = F.col("key").cast("string")
    return w.select(key.alias("key"), "title", F.array(author).alias("authors"), "year", "venue", F.lower("type").alias("type"), F.concat(F.lit("10.1000/"), key).alias("doi"), "abstract", F.array(p).alias("provenance"))


@query(
    f"""WITH {A.SQL_WORKS} SELECT key::VARCHAR AS key, 'TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || 'AU  - ' || regexp_replace(venue, '[^A-Za-z]', '', 'g') || ', X' || chr(10) || 'PY  - ' || year || chr(10) || 'JO  - ' || venue || chr(10)
    || 'DO  - 10.1000/' || key || coalesce(chr(10) || 'AB  - ' || abstract, '') || chr(10) || 'ID  - ' || key || chr(10) || 'ER  - ' AS entry FROM works"""
)
def ris_lines(spark, d):
    return exports.ris(_work_rows(spark, d))


SQL_BIB = f"""{A.SQL_WORKS}, base AS (SELECT key::VARCHAR AS key, lower(regexp_replace(venue, '[^A-Za-z]', '', 'g')) || year ||
  coalesce(list_filter(string_split(trim(regexp_replace(lower(title), '[^0-9a-z]+', ' ', 'g')), ' '), lambda x: length(x) > 3)[1], '') AS base FROM works),
num AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY key) AS n FROM base)"""


@query(f"WITH {SQL_BIB} SELECT key, CASE WHEN n > 1 THEN base || chr((96 + n)::INT) ELSE base END AS bibkey FROM num")
def bibtex_keys(spark, d):
    return exports.bibtex_keys(_work_rows(spark, d))


@query(f"WITH {A.SQL_WORKS} SELECT key::VARCHAR AS key, row_number() OVER (ORDER BY year DESC, key::VARCHAR)::BIGINT AS rank, printf('%.6f', year::DOUBLE) AS score, regexp_replace(venue, '[^A-Za-z]', '', 'g') || ', X' AS authors, 'a' AS providers FROM works")
def candidates_export(spark, d):
    w = _work_rows(spark, d)
    out = exports.candidates(w, w.select("key", F.col("year").cast("double").alias("score")))
    return longs(out.select("key", "rank", "score", "authors", "providers"))


@query("SELECT 'doi:10.1000/' || p_partkey AS ident, p_partkey::VARCHAR AS key FROM part UNION ALL SELECT 'OPENALEX:w' || p_partkey, p_partkey::VARCHAR FROM part UNION ALL SELECT 'nobody', NULL")
def alias_lookup(spark, d):
    """Identifiers of works resolved by exact name, then in lower case."""
    w = _work_rows(spark, d).withColumn("source_ids", F.create_map(F.lit("openalex"), F.concat(F.lit("W"), "key")))
    names = files.aliases(w)
    asked = w.select(F.concat(F.lit("doi:"), "doi").alias("ident")).union(w.select(F.concat(F.lit("OPENALEX:w"), "key"))).union(spark.range(1).select(F.lit("nobody")))
    return files.resolve_identifiers(asked, names)


@query(
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'https://doi.org/10.1000/P' || p_partkey ELSE 'doi:10.1000/p' || p_partkey END AS ident, CASE WHEN p_partkey % 3 = 0 THEN 'a:' || p_partkey WHEN p_partkey % 5 <> 0 THEN 'b:' || p_partkey END AS key,
    CASE WHEN p_partkey % 3 = 0 THEN 'a' WHEN p_partkey % 5 <> 0 THEN 'b' END AS provider FROM part UNION ALL SELECT 'nobody', NULL, NULL"""
)
def seed_resolution(spark, d):
    """Parts asked for by DOI at two providers, of which the first knows every third."""
    k = F.col("p_partkey").cast("string")
    p = A.table(spark, d, "part")
    idents = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/P"), k)).otherwise(F.concat(F.lit("doi:10.1000/p"), k)).alias("ident"))
    known = p.select(F.concat(F.lit("10.1000/p"), k).alias("ident"), F.array_compact(F.array(F.when(F.col("p_partkey") % 5 != 0, "b"), F.when(F.col("p_partkey") % 3 == 0, "a"))).alias("who"), k.alias("k"))
    names = known.select("ident", F.explode("who").alias("provider"), "k").select("ident", F.concat("provider", F.lit(":"), "k").alias("key"), "provider")
    return files.resolve_seeds(idents.union(spark.createDataFrame([("nobody",)], "ident string")), names, ["a", "b"])
