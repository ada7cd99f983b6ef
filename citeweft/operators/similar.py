"""All pairs of texts whose Jaro-Winkler similarity reaches a threshold, without comparing all with all.

What similarity needs of letters: for texts of x and y letters with m matched ones, the Jaro similarity is at most
(m / x + m / y + 1) / 3, m is at most the letters that both have, counted as often as both have them, and the common head
of p letters (four at most) lifts j to j + p / 10 (1 - j). So texts that reach the threshold have at least
(3 j - 1) x y / (x + y) letters in common, where j = (threshold - p / 10) / (1 - p / 10).

Texts of like length, in bands of a tenth, are cut into chunks, and each two chunks whose lengths allow a pair are a tile
that goes to one task. There lengths, heads and letter counts rule pairs out, and what is left is compared exactly, many
pairs at once. No pair is made outside its tile, and no pair above the threshold is lost. Texts of one language differ little
in their letters, so that at 0.9 the number of exact comparisons grows with the square of the texts.

Equal texts are one from the start. Nulls and empty texts are similar to nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jaro import HEAD, WEIGHT, Letters, Others
from ..storage import durable

#: How much longer a band ends than it begins.
BAND = 1.1


def least_jaro(least: float, head: Column | int) -> Column | float:
    """The Jaro similarity that a common head of so many letters leaves to be reached."""
    return (least - WEIGHT * head) / (1 - WEIGHT * head)


def _alphabet(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, "")), "")


def common_letters(a: Column, b: Column) -> Column:
    """Letters that both texts have, each as often as both have it."""
    return F.aggregate(_alphabet(a), F.lit(0), lambda s, c: s + F.least(F.length(a) - F.length(F.replace(a, c, F.lit(""))), F.length(b) - F.length(F.replace(b, c, F.lit("")))))


def _enough(a: Column, b: Column, least: float, common: Column) -> Column:
    x, y = F.length(a).cast("double"), F.length(b).cast("double")
    head = sum((((F.substring(a, 1, k) == F.substring(b, 1, k)) & (x >= k) & (y >= k)).cast("int") for k in range(2, HEAD + 1)), (F.substring(a, 1, 1) == F.substring(b, 1, 1)).cast("int"))
    need = F.try_divide((3 * least_jaro(least, head) - 1) * x * y, x + y) - 1e-6
    return (F.least(x, y) >= need) & (common >= need)


def possible(a: Column, b: Column, least: float) -> Column:
    """Whether lengths, heads and letters let two texts reach the similarity; false only where they do not."""
    return _enough(a, b, least, common_letters(a, b))


def lengths_allow(a: Column, b: Column, least: float) -> Column:
    """Whether lengths and heads let two texts reach the similarity; for a look before ``reached``."""
    return _enough(a, b, least, F.least(F.length(a), F.length(b)))


def reached(a: Column, b: Column, least: float) -> Column:
    """The similarity of two texts where it reaches the threshold, null elsewhere; many pairs at once."""

    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        rows = np.flatnonzero((x.fillna("") != "") & (y.fillna("") != ""))
        x, y = x.iloc[rows], y.iloc[rows]
        part = np.cumsum(x.str.len() + y.str.len()).to_numpy() // LETTERS
        for k in np.unique(part):
            here = part == k
            place, texts = pd.factorize(pd.concat([x[here], y[here]]))
            known, (i, j) = Letters(list(texts)), np.split(place, 2)
            kept = np.flatnonzero(known.ordered(i, j, least))
            score = known.similarity(i[kept], j[kept])
            out[rows[here][kept]] = np.where(score >= least, score, np.nan)
        # nulls, not NaN: the threshold is a condition later
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(scores, "double")(a, b)


#: Texts and letters of a chunk at most, texts at least, and tiles and tasks of each partition.
SIDES, LETTERS, TILES, TASKS = (256, 2048), 1 << 21, 16, 4
TILE = ("p_band", "p_chunk", "q_band", "q_chunk")


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / log(BAND)).cast("int")


def _chunks(texts: DataFrame, side: int) -> DataFrame:
    """(band, chunks) of texts (id, t, n, band): as many as keep each within the side and the letters of a chunk."""
    return texts.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / side, F.sum("n") / LETTERS)).cast("int").alias("chunks"))


def _compared(least: float, same: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def compared(tile: pd.DataFrame) -> pd.DataFrame:
        """The similar pairs of a tile: of texts of its left and of its right chunk."""
        texts, right = tile["t"].tolist(), tile["right"].to_numpy()
        known = Letters(texts)
        order = {t: k for k, t in enumerate(sorted(set(texts)))}
        place = np.array([order[t] for t in texts])
        one, other = np.flatnonzero(~right), np.flatnonzero(right)
        other = other[np.argsort(known.n[other], kind="stable")]
        lengths, ratio = known.n[other], 3 * least_jaro(least, HEAD) - 2
        held = Others(known, other, least)
        within = same and tuple(tile.loc[0, [*TILE[:2]]]) == tuple(tile.loc[0, [*TILE[2:]]])
        found, a, b, waiting = [], [], [], 0

        def judge() -> None:
            i, j = np.concatenate(a), np.concatenate(b)
            kept = known.ordered(i, j, least)
            i, j = i[kept], j[kept]
            if same:
                i, j = np.where(place[i] < place[j], i, j), np.where(place[i] < place[j], j, i)
            score = known.similarity(i, j)
            found.extend((texts[p], texts[q], s) for p, q, s in zip(i[score >= least], j[score >= least], score[score >= least], strict=True))

        for i in one:
            low, high = np.searchsorted(lengths, [known.n[i] * ratio - 1, known.n[i] / ratio + 1])
            near = held.possible(i, low, high)
            if within:  # the chunk is on both sides
                near = near[place[near] > place[i]]
            if len(near):
                a.append(np.full(len(near), i))
                b.append(near)
                waiting += len(near)
            if waiting >= 1 << 18:
                judge()
                a, b, waiting = [], [], 0
        if waiting:
            judge()
        return pd.DataFrame(found, columns=["a", "b", "score"])

    return compared


def similar(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """(a, b, score) for all pairs of different texts of left and right (t) that reach ``least``; right None: of left, a < b.

    Between two tables equal texts are a pair too, of similarity 1.
    """
    ratio = 3 * least_jaro(least, HEAD) - 2  # a partner has this share of the longer text's letters at least
    if ratio <= 0:
        raise ValueError(f"bounds on letters need a threshold above {2 / 3 + WEIGHT * HEAD / 3:.2f}")
    one = lambda df: durable(df.select("t").where("t <> ''").distinct().select(F.xxhash64("t").alias("id"), "t", F.length("t").alias("n"), _band(F.length("t")).alias("band")))
    texts = [one(left)] if right is None else [one(left), one(right)]
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = min(SIDES[1], max(SIDES[0], ceil(sqrt(texts[0].count() * texts[-1].count() / (2 * TILES * partitions)))))
    x, y = texts[0], texts[-1]
    blocks = [_chunks(x, side), _chunks(y, side)]
    p, q = (b.select(F.col("band").alias(f"{c}_band"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias(f"{c}_chunk")) for c, b in zip("pq", blocks, strict=True))
    apart = ceil(-log(ratio) / log(BAND)) + 1
    meet = F.abs(F.col("p_band") - F.col("q_band")) <= apart
    if right is None:
        meet = meet & ((F.col("p_band") < F.col("q_band")) | ((F.col("p_band") == F.col("q_band")) & (F.col("p_chunk") <= F.col("q_chunk"))))
    tiles = durable(p.crossJoin(q).where(meet))

    def dealt(rows: DataFrame, chunks: DataFrame, c: str, is_right: bool) -> DataFrame:
        placed = rows.join(F.broadcast(chunks), "band").select("t", F.col("band").alias(f"{c}_band"), F.pmod("id", F.col("chunks")).cast("int").alias(f"{c}_chunk"))
        return placed.join(tiles, [f"{c}_band", f"{c}_chunk"]).select(*TILE, F.lit(is_right).alias("right"), "t")

    rows = dealt(x, blocks[0], "p", False).union(dealt(y, blocks[1], "q", True))
    # by number, as tiles are small to read and long to compare: Spark would put many of them into one task
    return rows.repartition(TASKS * partitions, *TILE).groupBy(*TILE).applyInPandas(_compared(least, right is None), "a string, b string, score double")


def match_bibliographic(references: DataFrame, works: DataFrame, least: float = 0.9) -> DataFrame:
    """Candidates for references out of works: (path, ord, cand_ord, doi, score, title, year), most similar first.

    references (path, ord, title_norm), works (key, title_norm, title, doi, year); score is 100 times the similarity of the
    titles, ties go to the smaller key. References without a title, or with nothing similar, have no candidate.
    """
    from pyspark.sql import Window

    found = similar(references.select(F.col("title_norm").alias("t")), works.select(F.col("title_norm").alias("t")), least)
    hits = references.select("path", "ord", F.col("title_norm").alias("a")).join(found, "a").join(works.select("key", F.col("title_norm").alias("b"), "doi", "title", "year"), "b")
    place = F.row_number().over(Window.partitionBy("path", "ord").orderBy(F.desc("score"), "key"))
    return hits.select("path", "ord", place.alias("cand_ord"), "key", "doi", (100 * F.col("score")).alias("score"), "title", "year")
