"""Agreement and screening statistics over scores (key, rater, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Bucketed, dealt, durable


def common_basis(scores: DataFrame) -> DataFrame:
    """The scores of the keys that every rater has scored."""
    raters = scores.agg(F.count_distinct("rater").alias("raters"))
    full = scores.where("score is not null").groupBy("key").agg(F.count_distinct("rater").alias("k")).join(F.broadcast(raters)).where("k = raters").select("key")
    return scores.join(full, "key", "left_semi")


def icc21(scores: DataFrame) -> DataFrame:
    """Two-way random effects, single rater, absolute agreement: icc over complete rows."""
    whole = scores.agg(F.avg("score").alias("m"), F.count_distinct("key").alias("n"), F.count_distinct("rater").alias("k"))
    rows = scores.groupBy("key").agg(F.avg("score").alias("rm"))
    cols = scores.groupBy("rater").agg(F.avg("score").alias("cm"))
    one = F.broadcast(whole)
    ssr = rows.join(one).agg((F.sum(F.pow(F.col("rm") - F.col("m"), 2)) * F.first("k")).alias("ssr"))
    ssc = cols.join(one).agg((F.sum(F.pow(F.col("cm") - F.col("m"), 2)) * F.first("n")).alias("ssc"))
    sst = scores.join(one).agg(F.sum(F.pow(F.col("score") - F.col("m"), 2)).alias("sst"), F.first("n").alias("n"), F.first("k").alias("k"))
    all_ = sst.join(ssr).join(ssc)
    msr, msc = F.expr("ssr / (n - 1)"), F.expr("ssc / (k - 1)")
    mse = F.expr("(sst - ssr - ssc) / ((n - 1) * (k - 1))")
    n, k = F.col("n"), F.col("k")
    return all_.select("n", "k", F.try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n).alias("icc"))


def agreement(pairs: DataFrame) -> DataFrame:
    """n, observed agreement, Cohen's kappa with its normal 95% interval, and PABAK from rows (a boolean, b boolean)."""
    one = pairs.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"))
    one = one.withColumn("pe", F.expr("pa * pb + (1 - pa) * (1 - pb)"))
    one = one.withColumn("kappa", F.coalesce(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), F.lit(1.0)))
    half = 1.96 * F.coalesce(F.sqrt(F.expr("try_divide(po * (1 - po), n * (1 - pe) * (1 - pe))")), F.lit(0.0))
    return one.select("n", "po", "kappa", (F.col("kappa") - half).alias("kappa_low"), (F.col("kappa") + half).alias("kappa_high"), (2 * F.col("po") - 1).alias("pabak"))


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("r"), F.count("*").alias("n"))


def auc(rows: DataFrame) -> DataFrame:
    """Area under the curve from rows (score, positive), ties one half.

    Values are counted first; then running sums over the distinct values give every positive's share of negatives
    below it. Nothing is compared pair by pair.
    """
    by = rows.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = by.withColumn("u", F.col("p") * (below + F.col("q") / 2.0))
    return part.agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("q").cast("double")).alias("auc"), F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"))


def auc_by(rows: DataFrame) -> DataFrame:
    """As ``auc`` for each predictor of rows (name, score, positive); rows without score are left out."""
    by = rows.where("score is not null").groupBy("name", "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    w = Window.partitionBy("name").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    part = by.withColumn("u", F.col("p") * (F.coalesce(F.sum("q").over(w), F.lit(0)) + F.col("q") / 2.0))
    return part.groupBy("name").agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("q").cast("double")).alias("auc"), F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"))


def control_groups(rows: DataFrame, tau: float) -> DataFrame:
    """(name, n, include_rate, mean) of control groups in rows (name, score): blind controls, negative controls."""
    return rows.where("score is not null").groupBy("name").agg(F.count("*").alias("n"), F.avg((F.col("score") >= tau).cast("double")).alias("include_rate"), F.avg("score").alias("mean"))


def threshold_band(scores: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, n_included, n, share) of mean scores at each threshold."""
    mean = scores.groupBy("key").agg(F.avg("score").alias("score"))
    return mean.withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).groupBy("tau").agg(F.count_if(F.col("score") >= F.col("tau")).alias("n_included"), F.count("*").alias("n")).withColumn("share", F.col("n_included") / F.col("n"))


def robustness(a: DataFrame, b: DataFrame, tau: float, low: float, high: float) -> DataFrame:
    """Two score tables (key, score): flips over the threshold, those at the boundary, mean absolute difference, Cohen's kappa."""
    both = a.select("key", F.col("score").alias("x")).join(b.select("key", F.col("score").alias("y")), "key")
    flip = (F.col("x") >= tau) != (F.col("y") >= tau)
    share = lambda c: F.avg(c.cast("double"))
    one = both.agg(F.count("*").alias("n"), F.count_if(flip).alias("flips"), F.count_if(flip & F.col("x").between(low, high)).alias("boundary_flips"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), share(~flip).alias("po"), share(F.col("x") >= tau).alias("pa"), share(F.col("y") >= tau).alias("pb"))
    one = one.withColumn("pe", F.expr("pa * pb + (1 - pa) * (1 - pb)"))
    return one.select("n", "flips", "boundary_flips", "mae", F.coalesce(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), F.when(F.col("n") > 0, 1.0)).alias("kappa"))


def confusion(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall from rows (predicted, actual)."""
    p, a = F.col("predicted"), F.col("actual")
    one = pairs.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    return one.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def spread(scores: DataFrame) -> DataFrame:
    """(key, mean, spread, n): over the raters that scored a key."""
    return scores.where("score is not null and not isnan(score)").groupBy("key").agg(F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"), F.count("*").alias("n"))


def family_agreement(scores: DataFrame, family: Column) -> DataFrame:
    """(kind, n_pairs, mae): pairs of raters of one family, and of two; raters are few, keys are many."""
    rows = scores.withColumn("family", family)
    a = rows.select("key", F.col("rater").alias("ra"), F.col("family").alias("fa"), F.col("score").alias("x"))
    b = rows.select("key", F.col("rater").alias("rb"), F.col("family").alias("fb"), F.col("score").alias("y"))
    both = a.join(b, "key").where("ra < rb").withColumn("kind", F.when(F.col("fa") == F.col("fb"), "within").otherwise("between"))
    return both.groupBy("kind").agg(F.count("*").alias("n_pairs"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))


def between_families(scores: DataFrame, family: Column) -> DataFrame:
    """(first, second, n, pearson, icc, mae): the means of two families over the keys that all raters have scored.

    The ICC (two raters, absolute agreement) is in closed form from variances, so that all pairs take one aggregate.
    """
    scores = dealt(scores, scores.count(), "key")
    means = common_basis(scores).groupBy("key", family.alias("family")).agg(F.avg("score").alias("s"))
    a = means.select("key", F.col("family").alias("first"), F.col("s").alias("x"))
    b = means.select("key", F.col("family").alias("second"), F.col("s").alias("y"))
    both = a.join(b, "key").where("first < second").groupBy("first", "second").agg(
        F.count("*").alias("n"),
        F.corr("x", "y").alias("pearson"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"),
        (2 * F.var_samp((F.col("x") + F.col("y")) / 2)).alias("msr"),
        (F.var_samp("x") + F.var_samp("y")).alias("within"),
        (F.avg("x") - F.avg("y")).alias("gap"),
    )
    both = both.withColumn("mse", F.col("within") - F.col("msr")).withColumn("msc", F.col("n") * F.col("gap") * F.col("gap") / 2)
    icc = F.expr("try_divide(msr - mse, msr + mse + 2 * (msc - mse) / n)")
    return both.select("first", "second", "n", "pearson", icc.alias("icc"), "mae")


def within_families(scores: DataFrame, family: Column) -> DataFrame:
    """(family, k, n, icc): agreement of the raters of each family, over the keys that all of them have scored.

    Two-way random effects, single rater, absolute agreement, from sums by key and by rater. A family of one rater has no row.
    """
    rows = scores.where("score is not null").select("key", "rater", F.col("score").cast("double").alias("score"), family.alias("family"))
    sizes = rows.groupBy("family").agg(F.count_distinct("rater").alias("k")).where("k > 1")
    full = rows.groupBy("family", "key").agg(F.count_distinct("rater").alias("have"), F.sum("score").alias("t"), F.sum(F.col("score") * F.col("score")).alias("q")).join(F.broadcast(sizes), "family").where("have = k")
    whole = full.groupBy("family", "k").agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    by = rows.join(full.select("family", "key"), ["family", "key"], "left_semi").groupBy("family", "rater").agg(F.sum("score").alias("s")).groupBy("family").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    one = whole.join(by, "family").withColumn("g", F.expr("t * t / (n * k)")).withColumn("r", F.expr("tt / k - g")).withColumn("c", F.expr("ss / n - g"))
    one = one.withColumns({"msr": F.expr("try_divide(r, n - 1)"), "msc": F.expr("c / (k - 1)"), "mse": F.expr("try_divide(q - g - r - c, (n - 1) * (k - 1))")})
    return one.select("family", "k", "n", F.expr("try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n)").alias("icc"))


def blind_controls(rows: DataFrame, tau: float) -> DataFrame:
    """Known positives among candidates, from rows (score, positive): AUC with and without the lowest tenth of them.

    At least one is left out. n_excluded, positives at ``tau`` or above and the share of candidates there come along. All
    goes by counts of distinct scores.
    """
    by = rows.where("score is not null").groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("before", F.coalesce(F.sum("p").over(w), F.lit(0))).withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    drop = F.greatest(F.lit(1), F.floor(F.sum("p").over(Window.partitionBy()) / 10))
    by = by.withColumn("drop", drop).withColumn("left", F.col("p") - F.least("p", F.greatest(F.lit(0), F.col("drop") - F.col("before"))))
    u = F.col("below") + F.col("q") / 2.0
    area = lambda c: F.try_divide(F.sum(F.col(c) * u), F.sum(c) * F.sum("q").cast("double"))
    high = F.col("score") >= tau
    return by.agg(area("p").alias("auc"), area("left").alias("auc_trimmed"), (F.sum("p") - F.sum("left")).alias("n_excluded"), F.sum(F.when(high, F.col("p")).otherwise(0)).alias("positives_at_tau"), F.try_divide(F.sum(F.when(high, F.col("q")).otherwise(0)), F.sum("q")).alias("include_rate"))


def bootstrap_mean(values: DataFrame, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """mean, low, high of a percentile bootstrap over rows (key, value).

    Each row weighs Poisson(1) in each replicate, drawn from a hash of key and replicate, so that rows are never
    gathered or resampled and the result does not hang on the partitions.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "key", "replicate"), F.lit(1 << 30)) / float(1 << 30)
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 9):
        total += p
        steps.append(total)
        p /= k
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))
    each = values.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = each.groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return values.agg(F.avg("value").alias("mean")).join(ends)


# Words that carry no topic when records are screened.
SCREENING_STOPWORDS = """
    a an the and or but if of in on at to for with without by from as is are was were be been being this that
    these those it its their his her our your my we you they he she i not no nor so than then there here when
    where which who whom whose what how why all any both each few more most other some such only own same too very
    can will just should now do does did doing have has had having would could may might must about above after
    again against because before below between during into through under over further once study research paper
    article analysis based using use used approach method results new toward towards case review effect effects
    impact role via within among across novel
""".split()


def screening_terms(text: Column) -> Column:
    """Lower-case terms of three letters or more, hyphens inside, without the stop words; none for a null text."""
    stop = F.array(*map(F.lit, SCREENING_STOPWORDS))
    terms = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z\-]{2,})"), 1)
    return F.filter(terms, lambda t: ~F.array_contains(stop, t))


def tfidf(docs: DataFrame) -> DataFrame:
    """(key, term, w): sublinear tf, smooth idf, unit length. docs (key, terms).

    Counts and weights are written once each, in buckets by term: texts are taken apart once, whatever is made of the
    weights, and what joins or adds up terms reads them where they lie.
    """
    tf = Bucketed(docs.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")), "term").read()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    raw = tf.join(df, "term").join(F.broadcast(n)).select("key", "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    size = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return Bucketed(raw.join(size, "key").select("key", "term", (F.col("w") / F.col("size")).alias("w")), "term").read()


def topic_similarity(weights: DataFrame, core: DataFrame) -> DataFrame:
    """(key, similarity): cosine of each document with the centroid of the core ones."""
    centre = durable(weights.join(core.select("key"), "key", "left_semi").groupBy("term").agg(F.sum("w").alias("c")))
    size = centre.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
    # terms that the centroid has not add nothing, but a document of such terms alone has its row
    dots = weights.join(centre, "term", "left").groupBy("key").agg(F.sum(F.col("w") * F.coalesce("c", F.lit(0.0))).alias("dot"))
    return dots.join(F.broadcast(size)).select("key", F.coalesce(F.try_divide("dot", "size"), F.lit(0.0)).alias("similarity"))


def seed_leave_one_out(weights: DataFrame, core: DataFrame) -> DataFrame:
    """(key, similarity): cosine of each core document with the centroid of the others; none for fewer than three.

    weights has unit length (``tfidf``). Taking a document out of the sum is in closed form, so that one centroid does.
    A document without terms has similarity 0.
    """
    keys = core.select("key").distinct()
    inside = weights.join(keys, "key", "left_semi")
    centre = durable(inside.groupBy("term").agg(F.sum("w").alias("c")))
    whole = centre.agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    dots = inside.join(centre, "term").groupBy("key").agg(F.sum(F.col("w") * F.col("c")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("own"))
    n = keys.agg(F.count("*").alias("n"))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.col("cc") - 2 * F.col("dot") + F.col("own")))
    rows = keys.join(dots, "key", "left").join(F.broadcast(whole)).join(F.broadcast(n)).where("n >= 3")
    return rows.select("key", F.coalesce(F.try_divide(F.col("dot") - F.col("own"), rest * F.sqrt("own")), F.lit(0.0)).alias("similarity"))


def parse_scores(replies: DataFrame) -> DataFrame:
    """(key, score) from replies (reply): the last JSON array of {id, score} in a text; scores from 1 to 10 alone."""
    body = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    rows = replies.select(F.explode(F.from_json(body, "array<struct<id:string,score:double>>")).alias("x")).select(F.col("x.id").alias("key"), F.col("x.score").alias("score"))
    return rows.where("key is not null and score between 1 and 10")


def top_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """top_n and overlap of two rankings' heads: a tenth of the keys, 20 to 250. a, b (key, score)."""
    n = a.agg(F.least(F.lit(250), F.greatest(F.lit(20), F.floor(F.count("*") / 10))).cast("int").alias("top_n"))
    head = lambda df: df.orderBy(F.desc("score"), "key").limit(250)  # noqa: E731  no head is longer
    rank = lambda df, name: head(df).withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), "key"))).select("key", name)
    both = rank(a, "ra").join(rank(b, "rb"), "key")
    rows = n.join(both, (F.col("ra") <= F.col("top_n")) & (F.col("rb") <= F.col("top_n")), "left")
    return rows.agg(F.first("top_n").alias("top_n"), F.count("key").alias("overlap"))
