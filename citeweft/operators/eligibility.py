"""Which records may be screened, with the reason where not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip
from ..model import Eligibility


def reason(e: Eligibility) -> Column:
    """The first criterion that a work fails, or null; unknown metadata passes unless ``keep_unknown`` is off."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    strict, never = F.lit(not e.keep_unknown), F.lit(False)
    year, kind, lang = F.col("year"), F.coalesce("type", F.lit("")), F.coalesce("language", F.lit(""))
    steps: list[tuple[Column, str]] = [
        (blank("title") if e.require_title else never, "no_title"),
        (blank("abstract") if e.require_abstract else never, "no_abstract"),
        (F.coalesce("is_retracted", never) if e.exclude_retracted else never, "retracted"),
        (strict & year.isNull() & F.lit(e.year_min is not None or e.year_max is not None), "no_year"),
        (year < e.year_min if e.year_min is not None else never, "year_below_min"),
        (year > e.year_max if e.year_max is not None else never, "year_above_max"),
        (strict & (kind == "") if e.types else never, "no_type"),
        ((kind != "") & ~kind.isin(*e.types) if e.types else never, "type_not_allowed"),
        (strict & (lang == "") if e.languages else never, "no_language"),
        ((lang != "") & ~lang.isin(*e.languages) if e.languages else never, "language_not_allowed"),
    ]
    out = F.lit(None).cast("string")
    for test, name in reversed(steps):
        out = F.when(test, name).otherwise(out)
    return out


def fresh(works: DataFrame, decisions: DataFrame) -> DataFrame:
    """Works without a decision; those seen but not decided come again."""
    return works.join(decisions.select("key"), "key", "left_anti")


def rejection_report(marked: DataFrame) -> DataFrame:
    """(reason, value, n, share) from rows with ``reason``: what was rejected, and the values observed there."""
    value = F.when(F.col("reason").like("%type%"), F.col("type")).when(F.col("reason").like("%language%"), F.col("language")).when(F.col("reason").like("%year%"), F.col("year").cast("string"))
    counts = marked.where("reason is not null").groupBy("reason", F.coalesce(value, F.lit("(none)")).alias("value")).agg(F.count("*").alias("n"))
    total = marked.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("reason", "value", "n", (F.col("n") / F.col("total")).alias("share"))
