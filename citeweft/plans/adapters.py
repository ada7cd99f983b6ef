"""Bibliographic views of the driver's tables: plain projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works (key, title, venue, type, year, language)."""
    p = table(spark, sf_dir, "part")
    language = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 0, "de").otherwise("en")
    return p.select(
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("venue"),
        F.col("p_type").alias("type"),
        (1970 + F.col("p_size")).cast("int").alias("year"),
        language.alias("language"),
        (F.col("p_partkey") % 97 == 0).alias("is_retracted"),
        F.when(F.col("p_retailprice") > 950, F.col("p_name")).alias("abstract"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations between parts of one order, from a large line to a later one; the return flag is the provider."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    a = line.where("l_quantity > 40").select("l_orderkey", F.col("l_linenumber").alias("x"), F.col("l_partkey").alias("src"))
    b = line.select("l_orderkey", F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("provider"))
    both = a.join(b, "l_orderkey").where("x < y and src <> dst")
    return both.select("src", "dst", F.lit("backward").alias("direction"), "provider").distinct()


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("key"), (1970 + F.col("p_size")).cast("int").alias("year"))


def seeds(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """The n smallest gold keys, one trial."""
    return gold(spark, sf_dir).orderBy("key").limit(n).select(F.lit("t").alias("trial"), "key")


def text_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works: the first line of the text is the title, the source the author, copies share a DOI."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.format_string("d:%08d", "doc_id").alias("key"),
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("https://doi.org/10.1000/"), F.upper(F.substring(F.md5("text"), 1, 10))).alias("doi_raw"),
        F.col("source").alias("surname_raw"),
        (2000 + F.col("doc_id") % 3).cast("int").alias("year"),
        "lang",
        "text",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select(F.format_string("d:%08d", "doc_id").alias("key"), F.when(F.col("q") == 1, "include").otherwise("exclude").alias("decision"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), "label")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records scored by three raters from 1 to 10; the third has not scored all."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = F.col("o_totalprice") % 10
    three = F.array(
        F.struct(F.lit("a1").alias("rater"), (1 + F.floor(base * 0.9)).cast("double").alias("score")),
        F.struct(F.lit("a2").alias("rater"), (1 + F.floor((base * 0.7 + (k % 7) * 0.4) * 0.9)).cast("double").alias("score")),
        F.struct(F.lit("b1").alias("rater"), F.when(k % 11 != 0, 1 + F.floor((base * 0.5 + (k % 5) * 0.8) * 0.9)).cast("double").alias("score")),
    )
    return o.select(k.alias("key"), F.inline(three), (F.col("o_orderstatus") == "F").alias("actual"))


# The same views in SQL, as common table expressions.
SQL_WORKS = """works AS (SELECT p_partkey AS key, p_name AS title, p_brand AS venue, p_type AS type, (1970 + p_size)::INT AS year,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'de' ELSE 'en' END AS language, p_partkey % 97 = 0 AS is_retracted,
  CASE WHEN p_retailprice > 950 THEN p_name END AS abstract FROM part)"""
SQL_EDGES = """edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, 'backward' AS direction, b.l_returnflag AS provider
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey
  WHERE a.l_quantity > 40)"""
SQL_GOLD = "gold AS (SELECT p_partkey AS key, (1970 + p_size)::INT AS year FROM part WHERE p_type = 'ECONOMY')"
SQL_SEEDS = "seeds AS (SELECT 't' AS trial, key FROM gold ORDER BY key LIMIT 3)"
SQL_REACH = f"""{SQL_EDGES}, {SQL_GOLD}, {SQL_SEEDS},
reach(trial, key, n) AS (SELECT trial, key, 0 FROM seeds UNION
  SELECT r.trial, e.dst, r.n + 1 FROM reach r JOIN gold g ON g.key = r.key JOIN edges e ON e.src = r.key WHERE r.n < 25),
found AS (SELECT trial, key, min(n)::INT AS n, key IN (SELECT key FROM gold) AS included FROM reach GROUP BY trial, key)"""
SQL_ROUNDS = """rounds AS (SELECT trial, n, count(*)::BIGINT AS n_screened, count(*) FILTER (included)::BIGINT AS n_included FROM found WHERE n > 0 GROUP BY trial, n),
history AS (SELECT r.trial, n, n_screened, n_included, (sum(n_screened) OVER w)::BIGINT AS cumulative_screened,
  ((sum(n_included) OVER w) + (SELECT count(*) FROM found f WHERE f.n = 0 AND f.trial = r.trial))::BIGINT AS cumulative_included,
  n_included AS frontier_size, n_included / n_screened AS yield_rate
  FROM rounds r WINDOW w AS (PARTITION BY r.trial ORDER BY n))"""
SQL_HISTORY = f"{SQL_REACH},\n{SQL_ROUNDS}"
SQL_CAPTURES = f"""{SQL_REACH},
inc AS (SELECT key FROM found WHERE included),
captures AS (SELECT e.dst AS key, bool_or(provider = 'A') AS a, bool_or(provider = 'N') AS b, bool_or(provider = 'R') AS c
  FROM edges e JOIN inc x ON x.key = e.src JOIN inc y ON y.key = e.dst GROUP BY e.dst)"""
SQL_TEXT = r"""tw AS (SELECT printf('d:%08d', doc_id) AS key, doc_id, split_part(text, chr(10), 1) AS title,
  'https://doi.org/10.1000/' || upper(substr(md5(text), 1, 10)) AS doi_raw, source AS surname_raw, (2000 + doc_id % 3)::INT AS year, lang, text FROM documents),
tn AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(strip_accents(title)), 'ß', 'ss'), '^\s+|\s+$', '', 'g')),
  '^(erratum:|erratum to:|correction:|correction to:|corrigendum:|corrigendum to:|retraction:|retraction note:|withdrawn:)', ''), '[^0-9a-z]+', ' ', 'g')) AS title_norm,
  regexp_replace(lower(strip_accents(surname_raw)), '[^a-z]+', '', 'g') AS surname, '10.1000/' || lower(substr(md5(text), 1, 10)) AS doi FROM tw)"""
SQL_SCORES = """raw AS (SELECT o_orderkey AS key, o_totalprice % 10 AS base, o_orderstatus = 'F' AS actual FROM orders),
scores AS (SELECT key, 'a1' AS rater, (1 + floor(base * 0.9))::DOUBLE AS score, actual FROM raw UNION ALL
  SELECT key, 'a2', (1 + floor((base * 0.7 + (key % 7) * 0.4) * 0.9))::DOUBLE, actual FROM raw UNION ALL
  SELECT key, 'b1', CASE WHEN key % 11 <> 0 THEN (1 + floor((base * 0.5 + (key % 5) * 0.8) * 0.9))::DOUBLE END, actual FROM raw)"""


def sql_loglinear(tables: str, by: str) -> str:
    """Expressions that end in ``chosen``: the log-linear model of least AIC for each row of tables (by, y[7]), three arms.

    One step of the recursion sets one of a model's sums right; 300 rounds of them.
    """
    same = "list_sum(list_transform(range(1, 8), lambda q: CASE WHEN (q & {0}) = (p & {0}) THEN {1}[q] ELSE 0 END))"
    names = f"{by}, " if by else ""
    return f"""mods AS (SELECT * FROM (VALUES (0, '', 4, [4, 2, 1]), (1, '0:1', 5, [6, 1]), (2, '0:2', 5, [5, 2]), (3, '1:2', 5, [3, 4]), (4, '0:1,0:2', 6, [6, 5]), (5, '0:1,1:2', 6, [6, 3]), (6, '0:2,1:2', 6, [5, 3]), (7, '0:1,0:2,1:2', 7, [6, 5, 3])) m(model, terms, params, masks)),
begun AS (SELECT {names}y, model, params, masks, len(masks) AS sums, CASE WHEN params = 7 THEN list_transform(y, lambda x: greatest(x, 1e-8)) ELSE [1, 1, 1, 1, 1, 1, 1]::DOUBLE[] END AS cells FROM {tables} CROSS JOIN mods),
fit AS (SELECT *, 0 AS r FROM begun UNION ALL
  SELECT {names}y, model, params, masks, sums, list_transform(range(1, 8), lambda p: cells[p] * greatest({same.format("g", "y")}, 1e-8) / {same.format("g", "cells")}), r + 1
  FROM (SELECT *, masks[r % sums + 1] AS g FROM fit WHERE params < 7 AND r < 300 * sums)),
fitted AS (SELECT {names}y, model, terms, list_sum(y) AS seen, cells[4] * cells[2] * cells[1] * cells[7] / (cells[6] * cells[5] * cells[3]) AS unseen,
  2 * f.params - 2 * list_sum(list_transform(range(1, 8), lambda p: CASE WHEN y[p] > 0 THEN y[p] * ln(cells[p]) ELSE 0 END - cells[p] - lgamma(y[p] + 1))) AS aic
  FROM fit f JOIN mods USING (model) WHERE r = CASE WHEN f.params = 7 THEN 0 ELSE 300 * sums END),
best AS (SELECT * FROM fitted QUALIFY row_number() OVER (PARTITION BY {names}1 ORDER BY round(aic, 8), model) = 1),
judged AS (SELECT *, CASE WHEN seen = 0 THEN 'no_records' WHEN y[4] + y[5] + y[6] + y[7] = 0 OR y[2] + y[3] + y[6] + y[7] = 0 OR y[1] + y[3] + y[5] + y[7] = 0 THEN 'empty_arm'
  WHEN terms <> '' AND (y[3] = 0 OR y[5] = 0 OR y[6] = 0) THEN 'empty_pair_cell' WHEN seen + unseen <= 3 * seen THEN NULL ELSE 'implausible' END AS reason FROM best),
chosen AS (SELECT {names}seen::BIGINT AS n_observed, reason IS NULL AS estimable, reason, CASE WHEN reason IS NULL THEN seen + unseen END AS n_hat, CASE WHEN reason IS NULL THEN seen / (seen + unseen) END AS recall, CASE WHEN seen > 0 THEN terms END AS terms, CASE WHEN seen > 0 THEN aic END AS aic FROM judged)"""
