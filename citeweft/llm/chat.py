"""Chat formatting by event sourcing.

A log of events (conv_id, seq, message_id, event, role, text) is folded into final messages, and messages are
rendered with a template whose control strings cannot be forged by a text.

Events, in order of ``seq`` within a conversation:

* ``open``: a message begins; its role, and text if any.
* ``delta``: more text for a message, appended.
* ``edit``: the message's text is replaced; every message after it (greater ``message_id``) goes.
* ``regenerate``: as ``edit``, and the new text follows in deltas.

So an event counts unless a later ``edit`` or ``regenerate`` aims at its message or one before it; a message's role is the
last that any of its events names. Minima over ranges of seq, then within each, find that: no conversation is gathered
into a row or sorted in one task. Only ``digest``, whose hash goes over a whole conversation, reads one in one task.

Edge cases: null text is empty; null role is an empty role; null conv_id is a conversation of its own; events with
equal seq go by event name, then text; a repeated event counts as often as it stands there; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

START, END = "<|im_start|>", "<|im_end|>"
PIECE = re.compile(r"<\|im_start\|>(.*?)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    """No ``<|`` is left: a ``<``, any backslashes and a ``|`` get one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """Roles stand on one line: backslashes are doubled and line feeds written as ``\\n`` first."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, role, text) of a log of events."""
    log = pick(events, conv_id="bigint", seq="bigint", message_id="bigint", event="string", role="string", text="string")
    resets = F.col("event").isin("edit", "regenerate")
    # the least message that a later reset aims at: over ranges of seq first, then within each
    log = log.withColumn("range", F.shiftright("seq", 12))
    later = lambda *keys: Window.partitionBy("conv_id", *keys).rowsBetween(Window.unboundedPreceding, -1)
    ranges = log.groupBy("conv_id", "range").agg(F.min(F.when(resets, F.col("message_id"))).alias("least"))
    ranges = ranges.select(F.col("conv_id").alias("r_conv"), F.col("range").alias("r_range"), F.min("least").over(later().orderBy(F.desc("range"))).alias("after"))
    log = log.withColumn("reset", F.min(F.when(resets, F.col("message_id"))).over(later("range").orderBy(F.desc("seq"), F.desc("event"), F.desc("text"))))
    log = log.join(ranges, F.col("conv_id").eqNullSafe(F.col("r_conv")) & F.col("range").eqNullSafe(F.col("r_range")))
    log = log.withColumn("reset", F.least("reset", "after"))
    alive = F.col("reset").isNull() | (F.col("reset") > F.col("message_id"))
    # a message that was started again keeps the role it had; one that a reset before it has removed is gone
    at = F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text"))
    folded = log.groupBy("conv_id", "message_id").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "event", "role"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(alive, at))), lambda x: x["text"]), "").alias("text"),
        F.max(alive).alias("stays"),
    )
    return folded.where("stays").drop("stays")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row a message: ``piece``, its part of the formatted conversation, and the loss span in it.

    The formatted conversation is its pieces in order of message_id. ``loss_start`` and ``loss_end`` are code points
    within the piece and null where the role is not the trained one.
    """
    rows = pick(messages, conv_id="bigint", message_id="bigint", role="string", text="string")
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    rows = rows.select("conv_id", "message_id", head.alias("head"), body.alias("body"), (F.col("role") == trained).alias("learn"))
    begin = F.length("head")
    return rows.select(
        "conv_id",
        "message_id",
        F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
        F.when(F.col("learn"), begin).cast("int").alias("loss_start"),
        F.when(F.col("learn"), begin + F.length("body")).cast("int").alias("loss_end"),
    )


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


DIGESTED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads pieces back, sorted by conversation; holds hash states, never a conversation. Ids stay whole numbers or null."""
    now: object = batches  # equals no conv_id
    state: list = []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(DIGESTED)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, DIGESTED.types, strict=True)], schema=DIGESTED)

    for batch in batches:
        done = []
        for conv, piece, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
            if conv != now:
                if state:
                    done.append(_row(now, state))
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = PIECE.fullmatch(piece).groups()
            state[0] += 1
            state[1].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
            if a is not None:
                learnt = unescape(piece[a:b])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(piece)
        yield out(done)
    if state:
        yield out([_row(now, state)])


def _row(conv: object, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def digest(pieces: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations, a row each."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "message_id").mapInArrow(_digest, DIGEST)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows of whole turns as the log that a chat server would have written.

    Each row opens a message. An assistant's streams a first draft, is regenerated, and streams its text in two deltas;
    another's is sent with its text reversed, edited to the first half of the text, and completed by a delta. Rows go by
    turn, nulls first, then role and text; rows with an equal turn stay messages of their own.
    """
    rows = pick(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    # numbers over ranges of turns first, then within each
    rows = rows.withColumn("range", F.shiftright("turn", 10))
    ranges = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("conv_id").alias("r_conv"), F.col("range").alias("r_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text"))
    rows = rows.withColumn("at", at).join(ranges, F.col("conv_id").eqNullSafe(F.col("r_conv")) & F.col("range").eqNullSafe(F.col("r_range")))
    rows = rows.withColumn("message_id", (F.col("at") + F.col("base")).cast("bigint"))
    none = F.lit(None).cast("string")
    half = F.call_function("div", F.length("text"), F.lit(2)).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def steps(*each: tuple[str, Column, Column]) -> Column:
        return F.array(*(F.struct(F.lit(e).alias("event"), r.alias("role"), t.alias("text"), (8 * F.col("message_id") + k).alias("seq")) for k, (e, r, t) in enumerate(each)))

    role, text = F.col("role"), F.col("text")
    streamed = steps(("open", role, none), ("delta", none, tail), ("regenerate", none, none), ("delta", none, head), ("delta", none, tail))
    edited = steps(("open", role, F.reverse(text)), ("edit", none, head), ("delta", none, tail))
    return rows.select("conv_id", "message_id", F.inline(F.when(role == "assistant", streamed).otherwise(edited)))
