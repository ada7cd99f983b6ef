"""URL filters by association rules (DataFrame and SQL functions, Spark's own FP-growth).

URLs become sets of tokens (``tld=net``, ``domain=example.net``, ``host=…`` for each longer end of the host, ``sub=www``
for its first label, ``label=…`` for every label but the last, ``dir=en`` for every part of the path, ``arg=utm_source``, …).
FP-growth mines combinations of tokens that go with one label; rules are pruned by confidence, support and by
dropping those that a shorter rule already covers. Rules are matched through an inverted index, token to rules.

Explicit domain rules come first: the longest rule that fits decides, and what they decide is the labelled data
from which the method learns a verdict for the other URLs. What such a rule itself asks for, host endings and parts of the
path, is no evidence: with its own rows it only restates the rule, and with those of the others it stands under their label
alone. Those tokens are left out of all rows. A confidence counts by its
lower bound (Wilson's, ``z`` standard errors), so that few rows must agree more fully than many.

Edge cases: a null URL or one without ``://`` has empty host and path, no token but ``none``, and the default
verdict unless a rule is learned; repeated rows stay; no labelled row gives no learned rule; an empty table is empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, pick

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Learned:
    """A rule: all of ``tokens`` present gives ``verdict``."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: int


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """The distinct tokens of a URL; digits in parts of the path are one 0, what is too rare is left to ``mine``."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    named = host_ != ""
    domain = F.when(named & (n >= 2), F.concat(F.lit("domain="), F.get(labels, n - 2), F.lit("."), F.get(labels, n - 1)))
    dirs = F.filter(F.split(path_, "/"), lambda x: x != "")
    ends = F.regexp_extract(path_, r"(\.[A-Za-z0-9]{1,8})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    args = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("arg="), F.substring_index(x, "=", 1)))
    parts = F.transform(dirs, lambda x: F.concat(F.lit("dir="), F.regexp_replace(x, "[0-9]+", "0")))
    inner = F.transform(F.filter(F.slice(labels, 1, F.greatest(n - 1, F.lit(0))), lambda x: x != ""), lambda x: F.concat(F.lit("label="), x))
    # ends of three labels or more, the whole host first
    longer = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, k, n), ".")))
    longer = F.when(n >= 3, longer).otherwise(F.array().cast("array<string>"))
    one = F.array(
        F.when(named, F.concat(F.lit("tld="), F.element_at(labels, -1))),
        domain,
        F.when(named & (n >= 3), F.concat(F.lit("sub="), F.get(labels, F.lit(0)))),
        F.when(ends != "", F.concat(F.lit("ext="), ends)),
        F.when(~named, F.lit("none")),
    )
    return F.array_distinct(F.filter(F.concat(one, longer, inner, parts, args), lambda x: x.isNotNull()))


def explicit(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits, or null; rules: (verdict, rule)."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = F.lit(None).cast("string")
    for _, rule in reversed(longest):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9, max_tokens: int = 3, z: float = 0.0) -> list[Learned]:
    """Rules from rows (tokens, verdict), strongest first. Minimum support bounds their number.

    The search is FP-growth over the distinct token sets with the verdict as one more item. A rule is kept when its
    confidence, or its lower bound if ``z`` is set, and support suffice and no shorter part of it is kept for the same verdict.
    """
    items = durable(labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items")))
    if items.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets
    whole = durable(sets.where(F.size("items") <= max_tokens + 1))
    is_verdict = lambda x: x.startswith("verdict=")
    sides = whole.select(
        F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("tokens"),
        F.array_max(F.filter("items", is_verdict)).alias("verdict"),
        "freq",
    )
    alone = sides.where(F.col("verdict").isNull()).select("tokens", F.col("freq").alias("freq_tokens"))
    both = sides.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    rated = both.join(alone, "tokens").select("tokens", F.substring_index("verdict", "=", -1).alias("verdict"), (F.col("freq") / F.col("freq_tokens")).alias("confidence"), F.col("freq").cast("long").alias("support"))
    n, c = F.col("support") / F.col("confidence"), F.col("confidence")
    low = (c + z * z / (2 * n) - z * F.sqrt(c * (1 - c) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = durable(rated.where(low >= min_confidence))
    # a rule is covered if any shorter part of it is good: that part is kept, or a part of it is
    parts = "filter(aggregate(tokens, array(cast(array() as array<string>)), (all, t) -> concat(all, transform(all, x -> array_append(x, t)))), x -> size(x) > 0 and size(x) < size(tokens))"
    covered = good.select("tokens", "verdict", F.explode(F.expr(parts)).alias("part"))
    covered = covered.join(good.select(F.col("tokens").alias("part"), "verdict"), ["part", "verdict"], "left_semi").select("tokens", "verdict")
    kept = [Learned(tuple(r.tokens), r.verdict, float(r.confidence), int(r.support)) for r in good.join(covered, ["tokens", "verdict"], "left_anti").collect()]
    return sorted(kept, key=lambda k: (-k.confidence, -k.support, k.tokens, k.verdict))


def judge(tokens_: Column, learned: list[Learned], default: str = "allow") -> Column:
    """The verdict of the strongest learned rule whose tokens are all there, found through an inverted index."""
    if not learned:
        return F.lit(default)
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(learned):
        for t in rule.tokens:
            index.setdefault(t, []).append(k)
    lookup = F.create_map(*(x for t, ks in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    sizes = F.array(*(F.lit(len(r.tokens)) for r in learned))
    verdicts = F.array(*(F.lit(r.verdict) for r in learned))
    hits = F.flatten(F.filter(F.transform(tokens_, lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull()))
    full = lambda all_: F.filter(F.array_distinct(all_), lambda k: F.size(F.filter(all_, lambda h: h == k)) == F.get(sizes, k))
    first = F.array_min(F.get(F.transform(F.array(hits), full), F.lit(0)))
    return F.coalesce(F.get(verdicts, first), F.lit(default))


def implied(rule: str) -> list[str]:
    """The tokens that every URL has which an explicit rule ``host/path`` fits."""
    name, _, rest = rule.partition("/")
    labels = name.split(".")
    ends = [".".join(labels[k:]) for k in range(len(labels))]
    out = [f"tld={labels[-1]}", *(f"domain={x}" for x in ends if x.count(".") == 1), *(f"host={x}" for x in ends if x.count(".") > 1)]
    out += [f"label={x}" for x in labels[:-1]]
    return out + [f"dir={re.sub('[0-9]+', '0', x)}" for x in rest.split("/")[:-1] if x]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", labels: DataFrame | None = None, **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    ``rules``: (verdict, ``host/path``). ``labels``: rows (url, verdict) to learn from; without them, what the rules
    decide. Keywords go to ``mine``.
    """
    rows = pick(pages, page_id="bigint", url="string")
    rows = rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    of = {rule: verdict for verdict, rule in rules}
    rows = rows.withColumn("rule", explicit(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    said = F.lit(None).cast("string")
    for rule, verdict in sorted(of.items()):
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    rows = rows.withColumn("said", said)
    if labels is None:
        # what a rule asks for says nothing about the others' rows either: there it stands under their label alone
        asked = sorted({t for rule in of for t in implied(rule)})
        own_tokens = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")
        taught = rows.where(F.col("said").isNotNull()).select(F.array_except("tokens", own_tokens).alias("tokens"), F.col("said").alias("verdict"))
        mining = {"z": 1.645, **mining}
    else:
        own = pick(labels, url="string", verdict="string").where(F.col("verdict").isNotNull())
        own = own.select("url", "verdict", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        taught = own.select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "verdict")
    learned = mine(taught, **mining)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", judge(F.col("tokens"), learned, default)).alias("verdict"))
