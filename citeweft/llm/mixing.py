"""Mixing sources to target weights (DataFrame and SQL functions only).

The words of a source, document after document, are one stream, packed into blocks of ``block`` words. A source's
target decides how many words the mix takes: whole passes over its blocks, then a part of one more pass; each block taken
is a slot. Output shards draw their source counts: multinomial, given the sources' totals, so that the mix meets the
targets to the word. A source's slots are numbered shard by shard, and a slot's number goes through a pseudorandom
permutation of the source's block numbers (another one each pass): a Feistel network over two mixed digits of about the
square root of their number, repeated while it leads out of the numbers, which holds for any 64-bit number. Documents
meet the taken blocks by block number, and every piece knows its shard.

No source and no document is ever in one task: a source's stream is laid out by two levels of prefix sums, over
``PARTS`` hash parts of its documents and within each part.

Edge cases: null and empty texts have size 0 and give nothing; a null source is a source of its own, last in order;
repeated rows are documents of their own; all sizes zero gives zero targets; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, durable, pick

#: Hash parts of a source's documents; the same at every input size.
PARTS = 4096
#: Rounds of the permutation, and how often it is repeated at most: numbers that lead out are fewer than the square root.
ROUNDS, WALKS = 4, 64
WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text: Column) -> Column:
    """Number of words: runs of characters other than white space."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from rows (source, source_size), one a source.

    Sources in order of code points, nulls last, take the weights in turn and share ``total`` times all sizes. A
    target stops at ``most`` times its source's size; the excess goes to the others by weight. That is filling to one
    level: sources sorted by size over weight are full up to some place, and the rest share what is left.
    """
    w = F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights))
    order = Window.orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    rows = rows.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    up = Window.orderBy("ratio", "place")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("budget", total * F.sum("source_size").over(whole).cast("double"))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # level: what one unit of weight gets if all sources before this one are full
    rows = rows.withColumn("full", F.col("ratio") <= F.col("level"))
    # past the first source that is not full, levels fall
    rows = rows.withColumn("at", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("at")).alias("target"))


def _digits(*parts: Column) -> Column:
    """A pseudorandom number below 2**32 that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def _named(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, not once for each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permuted(number: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 for each key, that any SQL engine can repeat."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint") + 1
    b = F.call_function("div", n + a - 1, a)

    def turn(k: int):
        def of(p: Column) -> Column:
            if k % 2:
                return F.struct(p["low"].alias("low"), ((p["high"] + _digits(F.lit(str(k)), key, p["low"])) % b).alias("high"))
            return F.struct(((p["low"] + _digits(F.lit(str(k)), key, p["high"])) % a).alias("low"), p["high"].alias("high"))

        return of

    def once(x: Column) -> Column:
        pair = F.struct((x % a).alias("low"), F.call_function("div", x, a).alias("high"))
        for k in range(ROUNDS):
            pair = _let(pair, turn(k))
        return _let(pair, lambda p: p["high"] * a + p["low"])

    return _let(once(number), lambda first: F.when(first < n, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))))


def mix(documents: DataFrame, block: int = 64, shard_words: int = 1 << 16, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Documents placed in their streams, and the slots of the mix.

    placed: row_id, doc_id, text, source, size, source_size, target, begin (its first word in the source's stream).
    slots: source, pass_, block (number), first, length (words of the stream), shard, one row for each block taken.
    Runs with the same input agree.
    """
    rows = pick(documents, doc_id="bigint", text="string", source="string")
    rows = rows.withColumn("size", size_of(F.col("text"))).withColumn("part", (_digits(F.lit("part"), F.col("doc_id").cast("string")) % PARTS).cast("int"))
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    sizes = durable(rows.drop("text"))
    return place(sizes, block, shard_words, weights, total, most)


def place(sizes: DataFrame, block: int, shard_words: int, weights: tuple[float, ...], total: float, most: float) -> tuple[DataFrame, DataFrame]:
    """As ``mix``, from rows (doc_id, source, size, part, text_hash)."""
    parts = durable(sizes.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    per_source = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, total, most)
    per_source = durable(per_source.withColumn("all_words", F.sum("target").over(Window.partitionBy())))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead"))
    parts = parts.join(per_source, parts["source"].eqNullSafe(per_source["source"])).drop(per_source["source"]).drop("all_words")
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "text_hash", "size")
    docs = sizes.withColumn("within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    docs = docs.withColumn("copy", F.row_number().over(Window.partitionBy("source", "part", "doc_id", "text_hash").orderBy("size")))
    p = parts.withColumnRenamed("source", "p_source").withColumnRenamed("part", "p_part")
    placed = docs.join(p, (F.col("part") == F.col("p_part")) & F.col("source").eqNullSafe(F.col("p_source"))).select(
        "doc_id", "source", "size", "text_hash", "copy", "source_size", "target", (F.col("ahead") + F.col("within")).alias("begin")
    )
    # whole passes, then the rest; the short last block of a stream comes last in a pass
    taken = F.least(F.round("target").cast("bigint"), (F.lit(most) * F.col("source_size")).cast("bigint"))
    s = per_source.where(F.col("source_size") > 0).select("source", "source_size", "all_words", taken.alias("taken")).where("taken > 0")
    s = s.withColumn("each", F.ceil(F.col("source_size") / block).cast("bigint")).withColumn("passes", F.call_function("div", F.col("taken"), F.col("source_size")))
    s = s.withColumn("slots", F.col("passes") * F.col("each") + F.ceil((F.col("taken") - F.col("passes") * F.col("source_size")) / block).cast("bigint"))
    s = s.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("all_words") / shard_words)).cast("bigint")).withColumn("name", _named(F.col("source")))
    # the draw: every slot is thrown to a shard; small ranges, so that a large source's slots are thrown by many tasks
    thrown = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("slots") - 1, F.lit(4096)))))
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few small rows become many: not to be merged into few tasks
    thrown = thrown.repartition(tasks, "name", "chunk").withColumn("k", F.explode(F.sequence(F.col("chunk") * 4096, F.least(F.col("slots") - 1, F.col("chunk") * 4096 + 4095))))
    drawn = thrown.select("name", (_digits(F.lit("shard"), F.col("name"), F.col("k")) % F.col("shards")).alias("shard")).groupBy("name", "shard").agg(F.count("*").alias("n"))
    drawn = durable(drawn.withColumn("group", F.call_function("div", F.col("shard"), F.lit(4096))))
    # slots are numbered shard by shard: sums over groups of shards, then within each
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = drawn.groupBy("name", "group").agg(F.sum("n").alias("n")).select("name", "group", F.coalesce(F.sum("n").over(before("name", "group")), F.lit(0)).alias("base"))
    numbered = drawn.withColumn("inside", F.coalesce(F.sum("n").over(before("name", "group", "shard")), F.lit(0))).join(groups, ["name", "group"])
    slots = numbered.join(s, "name").repartition(tasks, "name", "shard")
    slots = slots.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).withColumn("at", F.col("base") + F.col("inside") + F.col("j"))
    slots = slots.withColumn("pass_", F.call_function("div", F.col("at"), F.col("each"))).withColumn("rank", F.col("at") % F.col("each"))
    full = F.call_function("div", F.col("source_size"), F.lit(block))
    number = F.when(F.col("rank") < full, permuted(F.col("rank"), full, F.concat_ws("|", "name", "pass_"))).otherwise(full)
    words = F.least(F.col("source_size"), F.col("taken") - F.col("pass_") * F.col("source_size"))
    slots = slots.select("source", "pass_", number.alias("block"), F.least(F.lit(block), words - F.col("rank") * block).cast("bigint").alias("length"), "shard")
    return placed, slots.select("source", "pass_", "block", (F.col("block") * block).alias("first"), "length", "shard")


def pieces(placed: DataFrame, slots: DataFrame, block: int = 64) -> DataFrame:
    """Documents met with taken blocks by block number.

    Rows: the columns of ``placed``, pass_, shard, skip (the document's words before the piece), n (its words).
    """
    spread = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("begin") / block).cast("bigint"), F.floor((F.col("begin") + F.col("size") - 1) / block).cast("bigint")))
    )
    t = slots.select(F.col("source").alias("t_source"), F.col("block").alias("t_block"), "first", "length", "pass_", "shard")
    # the planner sees the few sources that slots come from, not the many slots: it must not broadcast them
    met = spread.join(t.hint("merge"), (F.col("block") == F.col("t_block")) & F.col("source").eqNullSafe(F.col("t_source")))
    a = F.greatest("first", "begin")
    b = F.least(F.col("first") + F.col("length"), F.col("begin") + F.col("size"))
    return met.withColumn("skip", a - F.col("begin")).withColumn("n", b - a).where("n > 0").drop("t_source", "t_block", "block", "first", "length")


def taken_by_document(documents: DataFrame, block: int = 64, **options: object) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the first and last shard that any of it goes to: a row each."""
    placed, slots = mix(documents, block, **options)
    placed = durable(placed)
    # documents with words never share a beginning
    got = pieces(placed, slots, block).groupBy("source", "begin").agg(F.sum("n").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    got = got.select(F.col("source").alias("g_source"), F.col("begin").alias("g_begin"), "taken", "first_shard", "last_shard")
    fits = (F.col("begin") == F.col("g_begin")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") > 0)
    return placed.join(got.hint("merge"), fits, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard", "last_shard")


def _row_key() -> Column:
    """A 64-bit key of document, text and source, nulls told apart from values."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.col("text_hash"))


def mixed_documents(documents: DataFrame, block: int = 64, with_shard: bool = False, **options: object) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes any of it, with all its columns.

    A whole pass takes the text as it is; a partial one the taken words, in order, with blanks between. Rows that
    repeat document, text and source are copies: each of their uses carries the columns of the first. ``with_shard``:
    a row for each shard as well, and its number.
    """
    placed, slots = mix(documents, block, **options)
    keys = ["k", "copy", "pass_", "size", *["shard"] * with_shard]
    met = pieces(placed, slots, block).withColumn("k", _row_key()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("skip", "n"))).alias("runs"), F.sum("n").alias("n"))
    rows = pick(documents, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    # texts move once: rows that repeat document, text and source meet here, and the join goes by the same key
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("k", _row_key())
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("lang", "n_chars"))).where("nth = 1")
    both = rows.join(met.hint("merge"), "k").select("doc_id", "text", "lang", "source", "runs", "n", "size", *["shard"] * with_shard)
    ws = F.array_remove(F.split("text", SPACES), "")
    part = _let(ws, lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, (r["skip"] + 1).cast("int"), r["n"].cast("int")))), " "))
    text = F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(part)
    out = both.withColumn("text", text)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), *["shard"] * with_shard)
