"""Quality rules by learned decision lists (DataFrame and SQL functions only).

``statistics`` counts what a rule may look at, all inside one row at a time. ``learn`` grows and prunes rules by
sequential covering: a rule is a conjunction of thresholds; each is grown on two thirds of the labelled documents by
FOIL's gain, pruned on the other third, and kept while it stays precise there; then what it covers is set aside.
All labelled documents teach: thresholds, gains and precision come from counts over all of them, summed by the tasks.
``DecisionList.verdict`` is the ordered conditional expression.

Edge cases: null and empty texts have all counts 0 and shares 0; documents with several labels take the majority, ties
count as good; no labelled row or one class only gives an empty list, which keeps all; repeated rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, pick, words

#: What rules may test: shares of the counts below, comparable between short and long texts.
FEATURES = ("symbol_share", "upper_share", "bang_share", "repeat_share", "dup_line_share", "word_length", "distinct_share", "n_words")


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, not once for each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, others: str) -> Column:
    """Characters of a text outside the class ``others``."""
    return F.length(F.regexp_replace(text, others, "")).cast("bigint")


def repeated_words(ws: Column) -> Column:
    """Words that stand in a 3-word window which the text has twice or more.

    Each window is one number: its 64-bit hash, shifted to make room for its place. Sorted, equal windows are
    neighbours; their places, sorted again, cover up to three words each. From 4,096 words on, where less than 52 bits
    of the hash would be left, windows are pairs of the whole hash and the place, which takes longer.
    """

    def places(s: Column, bits: Column) -> Column:
        key = lambda x: F.call_function("shiftright", x, bits)
        twin = F.filter(s, lambda x, k: (key(x) == key(F.get(s, k + 1))) | (key(x) == key(F.get(s, k - 1))))
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        return F.sort_array(F.transform(twin, lambda x: x.bitwiseAND(mask)))

    def covered(at: Column) -> Column:
        one = F.transform(at, lambda x, k: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(at, k + 1) - x, F.lit(3).cast("bigint"))))
        return F.aggregate(one, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def paired(s: Column) -> Column:
        twin = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]))
        return F.sort_array(F.transform(twin, lambda x: x["at"]))

    def of(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n.cast("bigint")))
        starts = F.sequence(F.lit(0), n - 3)
        hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        hashes = F.transform(starts, lambda i: F.call_function("shiftleft", hashed(i), bits) + i)
        pairs = F.transform(starts, lambda i: F.struct(hashed(i).alias("h"), i.cast("bigint").alias("at")))
        short = _let(F.sort_array(hashes), lambda s: _let(places(s, bits), covered))
        long = _let(F.array_sort(pairs), lambda s: _let(paired(s), covered))
        # get() is null outside the array, so a null comparison must not hide the other one
        return F.when(n >= 4096, long).when(n >= 4, short).otherwise(F.lit(0).cast("bigint"))

    return _let(ws, of)


def statistics(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, the counts and the shares of each whole text."""
    rows = pick(documents, doc_id="bigint", text="string", **{c: dict(documents.dtypes)[c] for c in keep if c != "text"})
    text = F.coalesce("text", F.lit(""))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _count(text, r"[^#*$%&|<>]+").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _let(lines, F.size).cast("bigint").alias("n_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            _count(text, r"\P{Lu}+").alias("n_upper"),
            _count(text, r"[^!]+").alias("n_bangs"),
        )

    rows = rows.select("doc_id", *keep, _let(words(text), counts).alias("c")).select("doc_id", *keep, "c.*")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return rows.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("n_upper", "word_chars"),
            "bang_share": share("n_bangs", "n_words"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "word_length": share("word_chars", "n_words"),
            "distinct_share": share("n_distinct", "n_words"),
        }
    )


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Test:
    """feature <= threshold, or feature > threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = F.col(self.feature)
        return f > self.threshold if self.above else f <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a document that any of them covers is rejected."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def rejects(self) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(True)).otherwise(out)
        return out

    def rule(self) -> Column:
        """The rule that decided, or null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _all(rule: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.column()
    return out


#: Values are told apart to one in so many parts of a doubling where quantiles are read.
FINE = 256


def _value(cells: list[tuple[float, float, int]], place: float) -> float:
    """What stands at a place, from 0, among the values in order. cells: (least, most, values) in order."""

    def at(k: int) -> float:
        for low, high, n in cells:
            if k < n:
                return low + (high - low) * k / (n - 1) if n > 1 else low
            k -= n
        return cells[-1][1]

    low = at(int(place))
    return low + (place - int(place)) * (at(int(place) + 1) - low)


def quantiles(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Of each feature, ``bins`` quantiles and the ends among the bad rows and among the good ones.

    All rows are counted by feature, class and value, the latter to 1/``FINE`` of a doubling, so that what the driver
    gets is bounded by the span of the values. Where values are told apart, the quantiles are exact.
    """
    long = rows.select("bad", F.inline(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in FEATURES)))).where("x is not null")
    cell = F.when(F.col("x") != 0, F.floor(FINE * F.log2(F.abs("x"))))
    found: dict[tuple[str, bool], list[tuple[float, float, int]]] = {}
    for r in long.groupBy("f", "bad", F.signum("x").alias("sign"), cell.alias("cell")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect():
        found.setdefault((r.f, r.bad), []).append((r.low, r.high, r.n))
    out: dict[str, list[float]] = {f: [] for f in FEATURES}
    for (f, _), cells in sorted(found.items()):
        last = sum(n for *_, n in cells) - 1
        out[f] += [_value(sorted(cells), k * last / bins) for k in range(bins + 1)]
    return out


def learn(labelled: DataFrame, bins: int = 24, max_tests: int = 3, max_rules: int = 8, precision: float = 0.95, least: int = 5) -> DecisionList:
    """A list from rows (doc_id, the FEATURES, bad boolean), all of which are counted.

    Thresholds lie halfway between neighbours among the quantiles of the bad rows and of the good ones, ``bins`` of each
    and the ends.
    """
    part = F.pmod(F.xxhash64(F.lit("part"), F.coalesce("doc_id", F.lit(-1))), F.lit(3)) < 2
    rows = durable(labelled.select(part.alias("grow"), "bad", *(F.col(f).cast("double").alias(f) for f in FEATURES)))
    cuts = {}
    for f, x in quantiles(rows, bins).items():
        x = sorted(set(x))
        cuts[f] = [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)]
    features = [f for f in FEATURES if cuts[f]]
    if not features:
        return DecisionList()
    bin_of = [F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda x: F.col(f) > x)).alias(f) for f in features]  # noqa: B023
    cells = durable(rows.select("grow", "bad", *bin_of).groupBy("grow", "bad", *features).agg(F.count("*").alias("n")))

    def binned(test: Test) -> Column:
        k = cuts[test.feature].index(test.threshold)
        return F.col(test.feature) > k if test.above else F.col(test.feature) <= k

    def covered(rule: list[Test]) -> Column:
        out = F.lit(True)
        for t in rule:
            out = out & binned(t)
        return out

    def histogram(df: DataFrame) -> dict[str, dict[int, list[int]]]:
        """feature -> bin -> [bad, good]; as many rows as there are bins."""
        long = df.select("bad", "n", F.inline(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features))))
        out: dict[str, dict[int, list[int]]] = {f: {} for f in features}
        for r in long.groupBy("f", "b").agg(F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("q")).collect():
            out[r.f][r.b] = [r.p, r.q]
        return out

    def totals(df: DataFrame, rules: list[list[Test]]) -> list[tuple[int, int]]:
        columns = []
        for k, rule in enumerate(rules):
            for name, side in (("p", F.col("bad")), ("q", ~F.col("bad"))):
                columns.append(F.coalesce(F.sum(F.when(side & covered(rule), F.col("n"))), F.lit(0)).alias(f"{name}{k}"))
        r = df.agg(*columns).collect()[0]
        return [(r[f"p{k}"], r[f"q{k}"]) for k in range(len(rules))]

    out = DecisionList()
    left = cells
    while len(out.rules) < max_rules:
        rule: list[Test] = []
        grow, prune = left.where("grow"), left.where(~F.col("grow"))
        p, q = totals(grow, [[]])[0]
        if p < least:
            break
        while q and len(rule) < max_tests:
            best: tuple[float, Test, int, int] | None = None
            for f, by_bin in histogram(grow.where(covered(rule))).items():
                pp = qq = 0
                for k in range(len(cuts[f])):
                    pp, qq = pp + by_bin.get(k, [0, 0])[0], qq + by_bin.get(k, [0, 0])[1]
                    for above, a, b in ((False, pp, qq), (True, p - pp, q - qq)):
                        if a >= least and b < q:
                            gain = a * (log2(a / (a + b)) - log2(p / (p + q)))
                            test = Test(f, above, cuts[f][k])
                            if best is None or (gain, str(test)) > (best[0], str(best[1])):
                                best = gain, test, a, b
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            p, q = best[2], best[3]
        if not rule:
            break
        ways = [rule[: k + 1] for k in range(len(rule))]
        worth = totals(prune, ways)
        k = max(range(len(ways)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), -i))
        if worth[k][0] < precision * sum(worth[k]) or not worth[k][0]:
            break
        out.rules.append(tuple(ways[k]))
        left = left.where(~covered(ways[k]))
    return out


def taught(documents: DataFrame, labels: DataFrame, **options: float) -> DecisionList:
    """The list learned from labels (doc_id, quality), 0 for bad, and the documents they name."""
    return _taught(durable(statistics(documents)), labels, **options)


def _taught(stats: DataFrame, labels: DataFrame, **options: float) -> DecisionList:
    """From the documents' statistics, joined to all labels; documents that fail the base rules are not learned from."""
    votes = pick(labels, doc_id="bigint", quality="int").where("quality is not null and doc_id is not null")
    votes = votes.groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    return learn(stats.where(f"not ({BASE_FAILED})").select("doc_id", *FEATURES).join(votes, "doc_id"), **options)


def judge(documents: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The statistics of every document, counted once, base_failed, kept and the deciding rule."""
    rows = durable(statistics(documents)).withColumn("base_failed", F.expr(BASE_FAILED))
    found = _taught(rows, labels, **options)
    return rows.withColumn("kept", ~(F.col("base_failed") | found.rejects())).withColumn("rule", found.rule())


def kept_documents(documents: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The documents that pass, whole rows in their place; no text moves, so that texts are counted twice."""
    found = taught(documents, labels, **options)
    rows = pick(documents, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    return statistics(rows, keep=("lang", "source", "n_chars", "text")).where(f"not ({BASE_FAILED})").where(~found.rejects()).select(*rows.columns)
