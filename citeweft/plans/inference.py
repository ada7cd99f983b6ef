"""Queries whose weight is in the work: pairs of large blocks, intervals by replicates, matches without given candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import edits, intervals, pairs, resolve, similar, stopping, verify
from ..operators.kept import Clusters
from ..sinks import exports
from ..sources import provider
from ..storage import durable, shared_dir
from . import adapters as A
from . import queries as Q
from .queries import longs, query, r6

# --- pairs within large blocks -------------------------------------------------------------------------------------


@query(
    f"""WITH {A.SQL_TEXT}, r AS (SELECT key, surname, year, title_norm AS t FROM tn WHERE title_norm <> '')
    SELECT x.key AS a, y.key AS b, x.surname AS author, levenshtein(x.t, y.t)::BIGINT AS edits FROM r x JOIN r y ON x.surname = y.surname AND x.key < y.key AND abs(x.year - y.year) <= 1 AND CASE WHEN abs(length(x.t) - length(y.t)) <= 6 THEN levenshtein(x.t, y.t) ELSE 99 END <= 6"""
)
def author_block_pairs(spark, d):
    """Records of one author, years at most one apart, whose titles are at most six edits apart: few, very large blocks."""
    t = A.text_works(spark, d)
    r = t.select(Q.S.normalize_surname(F.col("surname_raw")).alias("block"), "key", "year", Q.S.normalize_title(F.col("title")).alias("t")).where("t <> '' and block is not null")
    r = durable(r.select("block", "key", "year", "t", F.xxhash64("block", "t").alias("gid")))
    texts = durable(r.groupBy("gid").agg(F.first("block").alias("block"), F.first("t").alias("t"), F.count("*").alias("n")))
    # titles meet once, whatever the number of their records
    own = texts.where("n > 1").select("block", F.col("gid").alias("a"), F.col("gid").alias("b"), F.lit(0).alias("edits"))
    alike = durable(edits.near_texts(texts.select("block", F.col("gid").alias("id"), "t"), 6).union(own))
    met = pairs.group_pairs(r.select("gid", "key", "year"), alike, ("year",), F.abs(F.col("p_year") - F.col("q_year")) <= 1)
    return met.select(F.least("p_key", "q_key").alias("a"), F.greatest("p_key", "q_key").alias("b"), F.col("block").alias("author"), F.col("edits").cast("long").alias("edits"))


# --- intervals by replicates ---------------------------------------------------------------------------------------

REPLICATES = 200
#: Weights of 200 replicates for each key of ``keyed`` (key, ...): 16 bits each of a digest of seed, key and number.
SQL_WEIGHTS = f"""blocks AS (SELECT *, range AS b, md5('0|' || key || '|' || range) AS h FROM keyed CROSS JOIN range({REPLICATES} // 8)),
weighed AS (SELECT * EXCLUDE (h, b), 8 * b + j AS r, len(list_filter({intervals.STEPS}, lambda t: t <= ('0x' || substr(h, 4 * j + 1, 4))::INT)) AS w FROM blocks CROSS JOIN (SELECT unnest(range(0, 8))::INT AS j))"""
SQL_ENDS = f"list_sort(list({{0}}))[{int(0.025 * REPLICATES) + 1}] AS low, list_sort(list({{0}}))[{int(0.975 * REPLICATES) + 1}] AS high"


@query(
    f"""WITH {Q.SQL_TWO}, keyed AS (SELECT key, x, actual FROM two), {SQL_WEIGHTS},
    b AS (SELECT r, x, coalesce(sum(w) FILTER (actual), 0) AS p, coalesce(sum(w) FILTER (NOT actual), 0) AS q FROM (SELECT r, x, actual, w FROM weighed UNION ALL SELECT -1, x, actual, 1 FROM keyed) GROUP BY r, x),
    u AS (SELECT r, p, q, p * (coalesce(sum(q) OVER (PARTITION BY r ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS u FROM b),
    area AS (SELECT r, sum(u) / (sum(p) * sum(q)) AS auc, sum(p) AS p, sum(q) AS q FROM u GROUP BY r),
    e AS (SELECT {SQL_ENDS.format("auc")} FROM area WHERE r >= 0)
    SELECT round(auc, 6) AS auc, round(low, 6) AS low, round(high, 6) AS high, p::BIGINT AS n_positive, q::BIGINT AS n_negative FROM area CROSS JOIN e WHERE r = -1"""
)
def auc_interval(spark, d):
    rows = Q._two(spark, d).select("key", F.col("x").alias("score"), F.col("actual").alias("positive"))
    return longs(intervals.auc_interval(rows, REPLICATES))


@query(
    f"""WITH {Q.SQL_BASIS}, keyed AS (SELECT key, list(score ORDER BY rater) AS s FROM basis GROUP BY key), {SQL_WEIGHTS},
    m AS (SELECT r, sum(w) AS n, sum(w * s[1]) AS c1, sum(w * s[2]) AS c2, sum(w * s[3]) AS c3, sum(w * (s[1] * s[1] + s[2] * s[2] + s[3] * s[3])) AS t, sum(w * (s[1] + s[2] + s[3]) ** 2) / 3 AS k
      FROM (SELECT r, s, w FROM weighed UNION ALL SELECT -1, s, 1 FROM keyed) GROUP BY r),
    g AS (SELECT r, n, (c1 + c2 + c3) ** 2 / (3 * n) AS g, (c1 * c1 + c2 * c2 + c3 * c3) / n AS c, t, k FROM m),
    ms AS (SELECT r, n, (k - g) / (n - 1) AS a, (c - g) / 2 AS b, (t - k - c + g) / (2 * (n - 1)) AS e FROM g),
    i AS (SELECT r, n, (a - e) / (a + 2 * e + 3 * (b - e) / n) AS icc FROM ms), e AS (SELECT {SQL_ENDS.format("icc")} FROM i WHERE r >= 0)
    SELECT n::BIGINT AS n, 3::BIGINT AS k, round(icc, 6) AS icc, round(low, 6) AS low, round(high, 6) AS high FROM i CROSS JOIN e WHERE r = -1"""
)
def icc_interval(spark, d):
    return longs(intervals.icc_interval(Q.stats.common_basis(A.scores(spark, d)), REPLICATES))


# --- matches without given candidates ------------------------------------------------------------------------------

SQL_NORM = "trim(regexp_replace(replace(lower(strip_accents(split_part({0}, chr(10), 1))), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))"


def _first_lines(spark, d, name: str, key: str):
    line = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return A.table(spark, d, name).select(key, line.alias("line"), Q.S.normalize_title(line).alias("title_norm"))


@query(
    f"""WITH t AS (SELECT DISTINCT {SQL_NORM.format("text")} AS t FROM documents), n AS (SELECT t FROM t WHERE t <> '')
    SELECT x.t AS a, y.t AS b, round(jaro_winkler_similarity(x.t, y.t), 6) AS score FROM n x JOIN n y ON x.t < y.t WHERE jaro_winkler_similarity(x.t, y.t) >= 0.9"""
)
def similar_titles(spark, d):
    """Pairs of different titles, the first lines of documents, that are spelt almost alike."""
    return longs(similar.similar(_first_lines(spark, d, "documents", "doc_id").select(F.col("title_norm").alias("t")), None, 0.9))


@query(
    f"""WITH w AS (SELECT doc_id, {SQL_NORM.format("text")} AS t FROM documents), r AS (SELECT item_id, {SQL_NORM.format("text")} AS t FROM benchmark),
    s AS (SELECT item_id, doc_id, jaro_winkler_similarity(r.t, w.t) AS score FROM r JOIN w ON r.t <> '' AND w.t <> '')
    SELECT item_id, doc_id, round(100 * score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS cand_ord FROM s WHERE score >= 0.85"""
)
def match_bibliographic(spark, d):
    """Items of the benchmark as references, documents as works: every candidate by its first line, in order."""
    refs = _first_lines(spark, d, "benchmark", "item_id").select(F.lit("benchmark").alias("path"), F.col("item_id").alias("ord"), "title_norm")
    works = _first_lines(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("key"), "title_norm", F.col("line").alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("int").alias("year"))
    found = similar.match_bibliographic(refs, works, 0.85)
    return longs(found.select(F.col("ord").alias("item_id"), F.col("key").alias("doc_id"), "score", F.col("cand_ord").cast("long").alias("cand_ord")))


# --- rules that a user adds ----------------------------------------------------------------------------------------


def falling_yield(history, trail=None, limit: float = -0.01):
    """A rule by an aggregate over the last three rounds: the slope of their yields."""
    make = stopping.window_rule("falling_yield", lambda w: F.regr_slope("yield_rate", "n").over(w), lambda v: v < limit, limit, rounds=3, least=3)
    return make(history)


@query(
    f"""WITH RECURSIVE {A.SQL_HISTORY}, v AS (SELECT n, yield_rate, frontier_size, cumulative_screened, CASE WHEN count(*) OVER w >= 3 THEN regr_slope(yield_rate, n) OVER w END AS slope FROM history WINDOW w AS (ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    f AS (SELECT n, slope, coalesce(slope < -0.01, false) AS own, cumulative_screened >= 1500 AS spent, frontier_size = 0 AS over_ FROM v)
    SELECT n::BIGINT AS n, round(slope, 6) AS value, own AS triggered, own OR spent OR over_ AS stop, CASE WHEN own THEN 'falling_yield' WHEN spent THEN 'budget' WHEN over_ THEN 'exhaustion' END AS stopped_by FROM f"""
)
def rule_custom(spark, d):
    """A registered rule beside the library's own: its decisions, and what it makes of the rule set."""
    stopping.register("falling_yield", falling_yield)
    h = Q.run_history(spark, d)
    said = stopping.evaluate(h, None, {"falling_yield": {}, "budget": {"max_screened": 1500}, "exhaustion": {}})
    own = said.where("rule = 'falling_yield'").select("n", "value", "triggered")
    return longs(own.join(stopping.rule_set(said, ["falling_yield", "budget", "exhaustion"]).drop("trial"), "n"))


# --- clusters over batches -----------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {Q.SQL_CLUSTERS} SELECT key, cluster AS rep FROM res")
def incremental_clusters(spark, d):
    """The clusters of all matches, taken in three batches: those by DOI, by equal titles, and the others."""
    found = durable(resolve.links(Q.records(spark, d)))
    kept = Clusters(spark)
    for tiers in (("T1",), ("T2",), ("T3", "T4")):
        kept.add(found.where(F.col("tier").isin(*tiers)))
    return kept.read()


# --- ordered text files --------------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT l_partkey AS key FROM lineitem UNION SELECT p_partkey FROM part), e AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem),
    x AS (SELECT 'node' AS kind, count(*)::BIGINT AS n, min(key)::BIGINT AS first, max(key)::BIGINT AS last FROM w UNION ALL SELECT 'edge', count(*), min(u), max(u) FROM e UNION ALL SELECT 'frame', 6, NULL, NULL)
    SELECT kind, n, first, last, true AS in_order FROM x"""
)
def graphml_file(spark, d):
    """Parts as nodes and suppliers' deliveries as edges, in one GraphML file, read back: its lines by kind, and their order."""
    line = A.table(spark, d, "lineitem")
    nodes = line.select(F.col("l_partkey").alias("key")).union(A.table(spark, d, "part").select("p_partkey")).distinct().select("key", F.concat(F.lit("part "), "key").alias("title"))
    edges = line.select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.lit("delivery").alias("provider")).distinct()
    path = f"{shared_dir(spark)}/citeweft/{uuid.uuid4().hex}.graphml"
    exports.write_graphml(nodes, edges, path)
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    kind = F.when(F.col("value").startswith("<node "), "node").when(F.col("value").startswith("<edge "), "edge").otherwise("frame")
    number = F.when(kind != "frame", F.regexp_extract("value", r'"(\d+)"', 1).cast("bigint"))
    rows = rows.select(kind.alias("kind"), number.alias("k"), "at")
    # the first of a kind stands before all others of it, the last behind them, and nodes before edges
    ends = rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"), F.min_by("k", "at").alias("top"), F.max_by("k", "at").alias("bottom"), F.min("at").alias("from"), F.max("at").alias("to"))
    edge = ends.where("kind = 'edge'").select(F.col("from").alias("edges_from"))
    ok = (F.col("kind") == "frame") | ((F.col("top") == F.col("first")) & (F.col("bottom") == F.col("last")) & ((F.col("kind") == "edge") | (F.col("to") < F.col("edges_from"))))
    return ends.join(F.broadcast(edge)).select("kind", "n", "first", "last", ok.alias("in_order"))


# --- conflicts, agreement within families, rationales, drift -------------------------------------------------------


@query(
    f"""WITH RECURSIVE {Q.SQL_CLUSTERS}, said AS (SELECT rep, r.key, unnest(['title', 'doi', 'year', 'language']) AS field, unnest([t.title, x.doi, x.year::VARCHAR, t.lang]) AS value
      FROM res r JOIN rec x ON x.key = r.key JOIN tn t ON t.key = r.key WHERE NOT suspicious),
    v AS (SELECT rep, field, value, min(key) AS first, max(key) AS last FROM said WHERE value <> '' GROUP BY ALL), k AS (SELECT rep, field, arg_min(value, first) AS kept FROM v GROUP BY ALL)
    SELECT rep, field, kept, arg_max(value, last) AS other FROM v JOIN k USING (rep, field) WHERE value <> kept GROUP BY ALL"""
)
def merge_conflicts(spark, d):
    """Titles, DOIs, years and languages in which documents that resolve to one differ."""
    r = Q.records(spark, d)
    works = r.select("key", "doi", "year").join(A.text_works(spark, d).select("key", "title", F.col("lang").alias("language")), "key")
    labels = resolve.labelled(r).where("not suspicious")
    return resolve.merge_conflicts(works, labels, ("title", "doi", "year", "language"))


@query(
    f"""WITH {A.SQL_SCORES}, r AS (SELECT key, rater, substr(rater, 1, 1) AS family, score FROM scores WHERE score IS NOT NULL), s AS (SELECT family, count(DISTINCT rater) AS k FROM r GROUP BY 1 HAVING count(DISTINCT rater) > 1),
    w AS (SELECT family, key, k FROM r JOIN s USING (family) GROUP BY ALL HAVING count(*) = k), b AS (SELECT r.*, k FROM r JOIN w USING (family, key)),
    g AS (SELECT family, k, avg(score) AS m, count(DISTINCT key) AS n FROM b GROUP BY ALL), rm AS (SELECT family, sum((x - m) ** 2) * k AS r FROM (SELECT family, key, avg(score) AS x FROM b GROUP BY ALL) JOIN g USING (family) GROUP BY family, k),
    cm AS (SELECT family, sum((x - m) ** 2) * n AS c FROM (SELECT family, rater, avg(score) AS x FROM b GROUP BY ALL) JOIN g USING (family) GROUP BY family, n), tt AS (SELECT family, sum((score - m) ** 2) AS t FROM b JOIN g USING (family) GROUP BY family),
    ms AS (SELECT family, k, n, r / (n - 1) AS r, c / (k - 1) AS c, (t - r - c) / ((n - 1) * (k - 1)) AS e FROM g JOIN rm USING (family) JOIN cm USING (family) JOIN tt USING (family))
    SELECT family, k::BIGINT AS k, n::BIGINT AS n, round((r - e) / (r + (k - 1) * e + k * (c - e) / n), 6) AS icc FROM ms"""
)
def within_families(spark, d):
    return longs(Q.stats.within_families(A.scores(spark, d), F.substring("rater", 1, 1)))


@query(
    f"""WITH RECURSIVE {A.SQL_HISTORY}, w AS (SELECT *, count(*) OVER v AS have, max(yield_rate) OVER v AS worst FROM history WINDOW v AS (ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
    SELECT n::BIGINT AS n, 'marginal_yield' AS rule, CASE WHEN have < 2 THEN 'There are not yet 2 rounds.' ELSE printf('Yield of the last 2 iterations is at most %.4f; the limit is 0.0800.', worst) END AS rationale FROM w UNION ALL
    SELECT n, 'budget', cumulative_screened || ' of 1500 records screened.' FROM history UNION ALL
    SELECT n, 'exhaustion', CASE WHEN frontier_size = 0 THEN 'No record is left to expand.' ELSE frontier_size || ' records are left to expand.' END FROM history"""
)
def rule_rationales(spark, d):
    """What each rule says of each round, in words."""
    return longs(Q._rules(spark, d).select("n", "rule", "rationale"))


@query(
    f"""WITH {Q.SQL_DRIFT}, asked AS (SELECT * FROM dr ORDER BY cache_key LIMIT 1000) SELECT count(*)::BIGINT AS entries_checked, count(*) FILTER (class = 'deindexed')::BIGINT AS deindexed, count(*) FILTER (class = 'deindexed') = 0 AS ok FROM asked"""
)
def verify_refresh(spark, d):
    """The first thousand cached requests, fetched anew through a fetcher."""
    old, new = Q._cache(spark, d)
    return verify.refresh(old, lambda asked: new.join(asked.select("cache_key"), "cache_key", "left_semi"), 1000)[1]


@query(
    """WITH o AS (SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status FROM orders), a AS (SELECT key, price FROM o WHERE status <> 'P'), b AS (SELECT key, CASE WHEN status = 'F' AND price > 300000 THEN price + 1 ELSE price END AS price FROM o WHERE status <> 'O' OR price < 350000)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.price IS DISTINCT FROM b.price"""
)
def drift_ranges(spark, d):
    """Two snapshots of orders, compared by the summaries of their ranges first."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    old = o.where("status <> 'P'").select("key", "price")
    new = o.where("status <> 'O' or price < 350000").select("key", F.when((F.col("status") == "F") & (F.col("price") > 300000), F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    base = f"{shared_dir(spark)}/citeweft/{uuid.uuid4().hex}"
    for name, rows in (("old", old), ("new", new)):
        verify.snapshot(rows, f"{base}/{name}", "key")
    return verify.drift_between(spark, f"{base}/old", f"{base}/new", "key")[0].select("key", "change")


# --- providers as a data source ------------------------------------------------------------------------------------


@query(f"WITH {A.SQL_EDGES} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, direction, provider FROM edges WHERE provider IN ('A', 'R')")
def provider_source(spark, d):
    """Edges landed as pages by provider, read again through the data source with a condition that it takes over."""
    e = A.edges(spark, d).select(F.col("src").cast("string").alias("key"), F.col("dst").cast("string").alias("dst"), "provider")
    path = f"{shared_dir(spark)}/citeweft/{uuid.uuid4().hex}"
    e.groupBy("provider", "key").agg(F.collect_list("dst").alias("references")).write.partitionBy("provider").json(path)
    provider.register(spark)
    return provider.edges(spark, path).where(F.col("provider").isin("A", "R"))
