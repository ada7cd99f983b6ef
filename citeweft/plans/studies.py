"""Queries of the studies; importing the module registers them beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import estimate, expand, simulate, stats, stopping, studies
from ..storage import durable
from . import adapters as A
from . import queries as Q
from .queries import longs, query

# --- trials --------------------------------------------------------------------------------------------------------

#: A crawl from each of four seed sets, its rounds, and the first round in which each provider captured a work.
SQL_TRIALS = f"""{Q.SQL_CITED}, starts AS ((SELECT 'most_cited/3/0' AS trial, key FROM cited ORDER BY coalesce(cited_by, 0) DESC, key LIMIT 3) UNION ALL (SELECT 'oldest/3/0', key FROM cited ORDER BY coalesce(year, 9999), key LIMIT 3)
  UNION ALL (SELECT 'random/3/0', key FROM cited ORDER BY md5('0|' || key), key LIMIT 3) UNION ALL (SELECT 'random/3/1', key FROM cited ORDER BY md5('1|' || key), key LIMIT 3)),
reach(trial, key, n) AS (SELECT trial, key, 0 FROM starts UNION SELECT r.trial, e.dst, r.n + 1 FROM reach r JOIN gold g ON g.key = r.key JOIN edges e ON e.src = r.key WHERE r.n < 25),
found AS (SELECT trial, key, min(n)::INT AS n, key IN (SELECT key FROM gold) AS included FROM reach GROUP BY trial, key),
{A.SQL_ROUNDS}, curve AS (SELECT *, least(1.0, cumulative_included / (SELECT count(*) FROM gold)) AS recall FROM history),
inc AS (SELECT trial, key, n FROM found WHERE included),
ways AS (SELECT y.trial, y.key, e.provider, greatest(y.n, x.n + 1) AS since FROM inc x JOIN edges e ON e.src = x.key JOIN inc y ON y.key = e.dst AND y.trial = x.trial)"""
SQL_COUNTS = f"""{SQL_TRIALS}, fi AS (SELECT trial, key, min(since) FILTER (provider = 'A') AS a, min(since) FILTER (provider = 'N') AS b, min(since) FILTER (provider = 'R') AS c FROM ways GROUP BY trial, key),
cap AS (SELECT r.trial, r.n, coalesce(a <= r.n, false) AS a, coalesce(b <= r.n, false) AS b, coalesce(c <= r.n, false) AS c FROM fi JOIN rounds r ON r.trial = fi.trial AND least(coalesce(a, 999), coalesce(b, 999), coalesce(c, 999)) <= r.n),
kt AS (SELECT trial, n, count(*) FILTER (a)::BIGINT AS n1, count(*) FILTER (b)::BIGINT AS n2, count(*) FILTER (a AND b)::BIGINT AS m, count(*)::BIGINT AS s_obs,
  count(*) FILTER (a::INT + b::INT + c::INT = 1)::BIGINT AS f1, count(*) FILTER (a::INT + b::INT + c::INT = 2)::BIGINT AS f2 FROM cap GROUP BY trial, n)"""


def _trials(spark, d, rounds: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Found works and recall curve of four trials, edges, and the number of gold works.

    Edges, gold works with their citations and the curve are written once: the seed sets, the crawl and what looks at
    its result read them in place of joining the lines again.
    """
    e = durable(A.edges(spark, d))
    gold = durable(Q.gold_cited(A.gold(spark, d), e))
    found = expand.snowball(e, simulate.trials(gold, ["most_cited", "oldest", "random"], [3], 2), gold, rounds)
    n = A.gold(spark, d).count()
    return found, durable(simulate.recall_curve(expand.history(found), n)), e, n


def _histories(found: DataFrame, curve: DataFrame, e: DataFrame) -> DataFrame:
    arms = {x: F.col("provider") == p for x, p in zip("abc", Q.ARMS, strict=True)}
    return studies.by_round(durable(studies.first_captures(found, e, arms)), curve, list("abc"))


def _results(spark, d) -> DataFrame:
    found, curve, e, _ = _trials(spark, d)
    rules = stopping.marginal_yield(curve, 0.08).union(stopping.budget(curve, 1500)).union(stopping.exhaustion(curve))
    kept = studies.until_stop(curve, stopping.rule_set(rules, ["marginal_yield", "budget", "exhaustion"]))
    counts = durable(studies.capture_counts(_histories(found, curve, e), list("abc")))
    return studies.trial_results(kept, estimate.chapman(counts.withColumn("n_observed", F.col("s_obs"))))


SQL_RESULTS = f"""{SQL_COUNTS}, ov AS (SELECT *, s_obs AS n_observed FROM kt), {Q.SQL_CHAPMAN},
fires AS (SELECT trial, n, count(*) OVER w >= 2 AND max(yield_rate) OVER w < 0.08 AS low, cumulative_screened >= 1500 AS spent, frontier_size = 0 AS done FROM history WINDOW w AS (PARTITION BY trial ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
lasts AS (SELECT trial, min(n) AS last, arg_min(CASE WHEN low THEN 'marginal_yield' WHEN spent THEN 'budget' ELSE 'exhaustion' END, n) AS stopped_by FROM fires WHERE low OR spent OR done GROUP BY trial),
kept AS (SELECT curve.*, stopped_by FROM curve LEFT JOIN lasts USING (trial) WHERE last IS NULL OR n <= last),
ends AS (SELECT trial, max(n) AS n, max(cumulative_included)::BIGINT AS n_found, max(recall) AS final_recall, count(*)::BIGINT AS iterations, max(cumulative_screened)::BIGINT AS total_screened, max(stopped_by) AS stopped_by,
  min(cumulative_screened) FILTER (recall >= 0.8)::BIGINT AS burden_80, min(cumulative_screened) FILTER (recall >= 0.9)::BIGINT AS burden_90, min(cumulative_screened) FILTER (recall >= 0.95)::BIGINT AS burden_95 FROM kept GROUP BY trial),
results AS (SELECT ends.* EXCLUDE (n), CASE WHEN estimable THEN least(1.0, n_observed / raw) END AS estimated_recall FROM ends LEFT JOIN cc ON cc.trial = ends.trial AND cc.n = ends.n)"""


@query(f"WITH RECURSIVE {SQL_RESULTS} SELECT * REPLACE (round(final_recall, 6) AS final_recall, round(estimated_recall, 6) AS estimated_recall) FROM results")
def benchmark_trials(spark, d):
    """Each trial up to its stop: what it found, screened and estimated, and which rule stopped it."""
    return longs(_results(spark, d))


@query(
    f"""WITH RECURSIVE {SQL_RESULTS}, p AS (SELECT estimated_recall - final_recall AS d FROM results WHERE estimated_recall IS NOT NULL)
    SELECT (SELECT count(*) FROM results)::BIGINT AS n_trials, (SELECT round(avg(final_recall), 6) FROM results) AS mean_final_recall, round(avg(d), 6) AS bias, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(avg((d > 0)::INT), 6) AS overestimate_rate, count(*)::BIGINT AS n_estimated FROM p"""
)
def benchmark_summary(spark, d):
    return longs(studies.benchmark_summary(_results(spark, d)))


@query(f"WITH {A.SQL_GOLD} SELECT key FROM (SELECT key FROM gold JOIN part ON p_partkey = key WHERE p_size % 3 = 0 ORDER BY p_retailprice DESC, key LIMIT 5) ORDER BY key")
def seed_boolean(spark, d):
    """Seeds that a search found, dearest parts first."""
    pool = A.table(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("key"), (-F.col("p_retailprice")).alias("place"))
    return simulate.select_seeds(A.gold(spark, d), "boolean", 5, pool=pool)


# --- coverage of the estimators ------------------------------------------------------------------------------------

#: The last round that has rows of coverage. What the estimators see there hangs on no later round, so none is crawled.
DEPTH = 6

SQL_COVERAGE = f"""{SQL_COUNTS}, ov AS (SELECT kt.*, cumulative_included AS n_observed FROM kt JOIN history USING (trial, n) WHERE n <= 6 AND cumulative_included >= 4), {Q.SQL_CHAPMAN},
c1 AS (SELECT *, NOT (s_obs = 0 OR (f2 = 0 AND f1 = s_obs)) AS ok, CASE WHEN f1 = 0 THEN s_obs WHEN f2 > 0 THEN s_obs + f1 * f1 / (2 * f2) ELSE s_obs + f1 * (f1 - 1) / 2 END AS nh FROM ov),
c2 AS (SELECT *, CASE WHEN f1 = 0 THEN 0 ELSE sqrt(greatest(0, CASE WHEN f2 > 0 THEN f2 * (0.5 * (f1 / f2) ** 2 + (f1 / f2) ** 3 + 0.25 * (f1 / f2) ** 4) ELSE 0.5 * f1 * (f1 - 1) + 0.25 * f1 * (2 * f1 - 1) ** 2 - f1 ** 4 / (4 * nh) END)) END AS sd FROM c1),
c3 AS (SELECT *, CASE WHEN nh > s_obs AND sd > 0 THEN exp(1.96 * sqrt(ln(1 + sd * sd / ((nh - s_obs) * (nh - s_obs))))) END AS k FROM c2),
cover AS (SELECT trial, n, 'chapman' AS estimator, estimable, CASE WHEN estimable THEN raw END AS n_hat, CASE WHEN estimable THEN lo END AS n_hat_low, CASE WHEN estimable THEN hi END AS n_hat_high FROM cc UNION ALL
  SELECT trial, n, 'chao1', ok, CASE WHEN ok THEN nh END, CASE WHEN ok THEN coalesce(s_obs + (nh - s_obs) / k, s_obs) END, CASE WHEN ok THEN CASE WHEN f1 = 0 THEN s_obs ELSE coalesce(s_obs + (nh - s_obs) * k, nh + 1.96 * sd) END END FROM c3)"""


def _coverage(spark, d) -> tuple[DataFrame, int]:
    found, curve, e, n = _trials(spark, d, DEPTH)
    counts = durable(studies.capture_counts(_histories(found, curve, e), list("abc")))
    return studies.coverage_rows(counts, curve, DEPTH), n


@query(f"WITH RECURSIVE {SQL_COVERAGE} SELECT trial, n::BIGINT AS n, estimator, estimable, round(n_hat, 4) AS n_hat, round(n_hat_low, 4) AS n_hat_low, round(n_hat_high, 4) AS n_hat_high FROM cover")
def coverage_rows(spark, d):
    rows = _coverage(spark, d)[0]
    return rows.select("trial", F.col("n").cast("long").alias("n"), "estimator", "estimable", *(F.round(c, 4).alias(c) for c in ("n_hat", "n_hat_low", "n_hat_high")))


@query(
    f"""WITH RECURSIVE {SQL_COVERAGE}, g AS (SELECT count(*) AS t FROM gold) SELECT estimator, count(*)::BIGINT AS cells, count(*) FILTER (estimable)::BIGINT AS estimable, round(avg((n_hat - t) / t) FILTER (estimable), 6) AS relative_bias,
    round(avg((t BETWEEN n_hat_low AND n_hat_high)::INT) FILTER (estimable), 6) AS coverage FROM cover CROSS JOIN g GROUP BY estimator"""
)
def coverage_study(spark, d):
    rows, n = _coverage(spark, d)
    return longs(studies.coverage_summary(rows, n))


@query(
    f"""WITH RECURSIVE {SQL_COUNTS}, deep AS (SELECT trial, n FROM history WHERE n <= 6 AND cumulative_included >= 4),
    tabled AS (SELECT trial, n, list_transform(range(1, 8), lambda p: len(list_filter(l, lambda x: x = p)))::DOUBLE[] AS y FROM (SELECT trial, n, list(4 * a::INT + 2 * b::INT + c::INT) AS l FROM cap JOIN deep USING (trial, n) GROUP BY trial, n)),
    {A.sql_loglinear("tabled", "trial, n")} SELECT trial, n::BIGINT AS n, 'loglinear' AS estimator, estimable, round(n_hat, 4) AS n_hat, NULL::DOUBLE AS n_hat_low, NULL::DOUBLE AS n_hat_high FROM chosen"""
)
def coverage_loglinear(spark, d):
    found, curve, e, _ = _trials(spark, d, DEPTH)
    rows = studies.coverage_loglinear(_histories(found, curve, e), curve, list("abc"), DEPTH)
    return rows.withColumn("n", F.col("n").cast("long")).withColumn("n_hat", F.round("n_hat", 4))


# --- stops ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {A.SQL_HISTORY}, ra AS (SELECT n, cumulative_included::DOUBLE AS y, rate, 1 - exp(-0.05::DOUBLE * rate * n) AS g FROM history CROSS JOIN range(1, 61) r(rate)),
    su AS (SELECT n, y, rate, count(*) OVER w AS points, sum(g * g) OVER w AS gg, sum(g * y) OVER w AS gy, sum(y * y) OVER w AS yy FROM ra WINDOW w AS (PARTITION BY rate ORDER BY n ROWS UNBOUNDED PRECEDING)),
    gr AS (SELECT *, y * (1 + step / 40) AS top FROM su CROSS JOIN range(0, 81) s(step) WHERE points >= 4 AND y > 0),
    be AS (SELECT n, y / top AS value, row_number() OVER (PARTITION BY n ORDER BY top * top * gg - 2 * top * gy + yy, step, rate) AS k FROM gr)
    SELECT h.n::BIGINT AS n, coalesce(value >= 0.95, false) AS triggered, round(value, 6) AS value FROM history h LEFT JOIN be ON be.n = h.n AND be.k = 1"""
)
def asymptote_grid(spark, d):
    return longs(studies.asymptote_grid(Q.run_history(spark, d)).select("n", "triggered", "value"))


@query(
    f"""WITH RECURSIVE {Q.SQL_RULES}, curve AS (SELECT *, least(1.0, cumulative_included / (SELECT count(*) FROM gold)) AS recall FROM history), f AS (SELECT rule, min(n) FILTER (triggered) AS fired_at FROM rules GROUP BY rule),
    o AS (SELECT min(n) FILTER (recall >= 0.3) AS optimal_n, min(cumulative_screened) FILTER (recall >= 0.3) AS least_, max(recall) AS ceiling, max(cumulative_included) AS all_ FROM curve)
    SELECT rule, fired_at::BIGINT AS fired_at, optimal_n::BIGINT AS optimal_n, round(recall, 6) AS recall_at_stop, (fired_at - optimal_n)::BIGINT AS overshoot, (cumulative_screened - least_)::BIGINT AS excess, (all_ - cumulative_included)::BIGINT AS missed, round(ceiling - recall, 6) AS regret
    FROM f CROSS JOIN o LEFT JOIN curve c ON c.n = f.fired_at"""
)
def curve_outcomes(spark, d):
    curve, _ = Q._curve(spark, d)
    return longs(studies.curve_outcomes(curve, stopping.first_fired(Q._rules(spark, d)), 0.3).drop("trial"))


#: Two arms by setting: the providers that each takes. Where the arms share a provider, they overlap much.
SETTINGS = {"optimistic": (("A", "N"), ("N", "R")), "calibrated": (("A",), ("R",))}
_WAYS = " UNION ALL ".join(
    f"SELECT '{s}' AS setting, trial, key, min(since) FILTER (provider IN ({', '.join(map(repr, a))})) AS a, min(since) FILTER (provider IN ({', '.join(map(repr, b))})) AS b FROM ways GROUP BY trial, key" for s, (a, b) in SETTINGS.items()
)


@query(
    f"""WITH RECURSIVE {SQL_TRIALS}, fi AS ({_WAYS}), cap AS (SELECT setting, r.trial, r.n, coalesce(a <= r.n, false) AS a, coalesce(b <= r.n, false) AS b FROM fi JOIN rounds r ON r.trial = fi.trial AND least(coalesce(a, 999), coalesce(b, 999)) <= r.n),
    ov AS (SELECT setting, trial, n, count(*) FILTER (a)::BIGINT AS n1, count(*) FILTER (b)::BIGINT AS n2, count(*) FILTER (a AND b)::BIGINT AS m, count(*)::BIGINT AS n_observed FROM cap GROUP BY ALL), {Q.SQL_CHAPMAN},
    good AS (SELECT setting, trial, n, n_observed / hi AS low, abs(raw - lag(raw) OVER w) / lag(raw) OVER w AS step, row_number() OVER w AS points FROM cc WHERE estimable AND raw > 0 WINDOW w AS (PARTITION BY setting, trial ORDER BY n)),
    dr AS (SELECT *, max(step) OVER (PARTITION BY setting, trial ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS drift FROM good),
    fired AS (SELECT setting, trial, min(n) AS fired_at FROM dr WHERE least(1.0, low) >= 0.6 AND points > 2 AND drift <= 0.05 GROUP BY ALL),
    per AS (SELECT setting, trial, avg(m / n_observed) AS mean_overlap FROM ov GROUP BY ALL), reach2 AS (SELECT trial, max(recall) AS reachable FROM curve GROUP BY trial)
    SELECT setting, count(*)::BIGINT AS reviews, round(avg(coalesce(mean_overlap, 0)), 6) AS mean_overlap, count(fired_at)::BIGINT AS fired, round(avg(c.recall), 6) AS recall_at_fire, round(avg(reachable), 6) AS reachable
    FROM reach2 CROSS JOIN (VALUES ('optimistic'), ('calibrated')) t(setting) LEFT JOIN per USING (setting, trial) LEFT JOIN fired USING (setting, trial) LEFT JOIN curve c ON c.trial = reach2.trial AND c.n = fired_at GROUP BY setting"""
)
def calibrated_overlap(spark, d):
    """Whether the recall rule still fires where arms overlap little."""
    found, curve, e, _ = _trials(spark, d)
    out = None
    for name, (a, b) in SETTINGS.items():
        firsts = studies.first_captures(found, e, {"a": F.col("provider").isin(*a), "b": F.col("provider").isin(*b)})
        counts = durable(studies.capture_counts(studies.by_round(firsts, curve, ["a", "b"]), ["a", "b"]))
        one = studies.overlap_reviews(counts, curve, 0.6).withColumn("setting", F.lit(name))
        out = one if out is None else out.union(one)
    return longs(studies.overlap_summary(out))


# --- cases and agreement -------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT o_orderstatus AS k, avg(o_totalprice % 10) / 10 AS recall, count(*) FILTER (o_custkey % 5 = 0) / count(*) AS un, count(DISTINCT o_custkey)::DOUBLE AS it, count(*) FILTER (o_totalprice % 10 < 3) / count(*) FILTER (o_totalprice % 10 < 6) AS cap FROM orders GROUP BY 1),
    l AS (SELECT k, unnest(['recall is lower', 'more is unresolvable', 'fewer rounds', 'less is captured']) AS prediction, unnest([-1, 1, 0, -1]) AS sign, unnest([recall, un, it, cap]) AS v FROM c),
    p AS (SELECT prediction, sign, max(v) FILTER (k = 'F') AS a, max(v) FILTER (k = 'O') AS f FROM l GROUP BY ALL)
    SELECT prediction, round(a, 6) AS adverse, round(f, 6) AS favourable, CASE WHEN sign = 0 THEN true ELSE a IS NOT NULL AND f IS NOT NULL END AS testable, CASE WHEN sign <> 0 THEN coalesce((a - f) * sign > 0, false) END AS held FROM p"""
)
def case_predictions(spark, d):
    """Orders by status as cases."""
    digit = F.col("o_totalprice") % 10
    o = A.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("case"))
    cases = o.agg((F.avg(digit) / 10).alias("recall"), F.count_if(F.col("o_custkey") % 5 == 0).alias("unresolvable"), F.count("*").alias("identified"), F.count_distinct("o_custkey").alias("iterations"), F.count_if(digit < 6).alias("included"), F.count_if(digit < 3).alias("captured"), F.lit(True).alias("saturation"))
    return longs(studies.predictions(cases, "F", "O"))


SQL_PO = f"{Q.SQL_TWO}, o AS (SELECT count(*)::BIGINT AS n, avg(((x >= 6) = (y >= 6))::INT) AS po, avg((x >= 6)::INT) AS pa, avg((y >= 6)::INT) AS pb FROM two), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM o), k AS (SELECT n, (po - pe) / (1 - pe) AS kappa, 1.96 * sqrt(po * (1 - po) / (n * (1 - pe) ** 2)) AS h FROM e)"


@query(f"WITH {SQL_PO} SELECT n, round(kappa, 6) AS kappa, round(kappa - h, 6) AS kappa_low, round(kappa + h, 6) AS kappa_high FROM k")
def cohen_kappa_interval(spark, d):
    return longs(stats.agreement(Q._two(spark, d).select((F.col("x") >= 6).alias("a"), (F.col("y") >= 6).alias("b"))).select("n", "kappa", "kappa_low", "kappa_high"))


@query(
    f"""WITH {Q.SQL_BASIS}, m AS (SELECT key, substr(rater, 1, 1) AS f, avg(score) AS s FROM basis GROUP BY ALL), p AS (SELECT x.f AS first, y.f AS second, x.s AS x, y.s AS y FROM m x JOIN m y ON x.key = y.key AND x.f < y.f),
    g AS (SELECT first, second, count(*) AS n, corr(x, y) AS r, avg(abs(x - y)) AS mae, 2 * var_samp((x + y) / 2) AS msr, var_samp(x) + var_samp(y) AS w, avg(x) - avg(y) AS gap FROM p GROUP BY ALL)
    SELECT first, second, n::BIGINT AS n, round(r, 6) AS pearson, round((2 * msr - w) / (w + 2 * (n * gap * gap / 2 - w + msr) / n), 6) AS icc, round(mae, 6) AS mae FROM g"""
)
def between_families(spark, d):
    return longs(stats.between_families(A.scores(spark, d), F.substring("rater", 1, 1)))


@query(
    f"""WITH {Q.SQL_BASIS}, m AS (SELECT key, bool_or(actual) AS positive, avg(score) AS s FROM basis GROUP BY key), k AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY s, key) AS r, count(*) FILTER (positive) OVER () AS np FROM m),
    b AS (SELECT s, count(*) FILTER (positive) AS p, count(*) FILTER (positive AND r > greatest(1, np // 10)) AS t, count(*) FILTER (NOT positive) AS q FROM k GROUP BY s), u AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2 AS below FROM b)
    SELECT round(sum(p * below) / (sum(p) * sum(q)), 6) AS auc, round(sum(t * below) / (sum(t) * sum(q)), 6) AS auc_trimmed, (sum(p) - sum(t))::BIGINT AS n_excluded, (sum(p) FILTER (s >= 7))::BIGINT AS positives_at_tau, round(sum(q) FILTER (s >= 7) / sum(q), 6) AS include_rate FROM u"""
)
def blind_controls(spark, d):
    mean = stats.common_basis(A.scores(spark, d)).groupBy("key").agg(F.avg("score").alias("score"), F.bool_or("actual").alias("positive"))
    return longs(stats.blind_controls(mean, 7))
