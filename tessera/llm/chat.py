"""Chat formatting by event-sourced reconstruction (DataFrame operations only).

A log holds rows (conv_id, seq, kind, turn, role, text): ``message`` sets a turn,
``delta`` appends a streamed piece, ``edit`` replaces the text so far, ``regenerate``
discards it and starts again (its own text, if any, is the first piece). The log is
partitioned by conversation and turn, sorted by seq and folded into final messages, which
are rendered in one string per conversation::

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings can't occur inside: a backslash is doubled, then ``<|`` becomes ``<\\|``, and
in roles a newline becomes ``<\\/``. Between ``<`` and what follows an original run of
backslashes is even after doubling, so the single one is unmistakable and the way back exact.
The loss mask lists (start, length), in code points, of the texts of assistant turns.

Defined results: null role or text counts as empty; the log's turns are numbers without
nulls. Finished rows are numbered by turn, null first; rows that share a turn are separate
turns in order of role and text; a log
without rows gives no conversation. A conversation is one row of the result, so it is
held by one task; nothing else is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def as_events(turns: DataFrame) -> DataFrame:
    """Finished rows (conv_id, turn, role, text) as the log a streamed chat leaves: a message
    that opens the turn with its role, then its text as a delta. Turns are numbered anew from 1."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", "text")
    event = lambda n, kind, role, text: F.struct((2 * F.col("turn") + n).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    both = F.array(event(0, "message", F.col("role"), none), event(1, "delta", none, F.col("text")))
    return rows.select("conv_id", "turn", F.inline(both)).select("conv_id", "seq", "kind", "turn", "role", "text")


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log with unique seq in each conversation.
    A turn's role is the first that its rows name."""
    turn = Window.partitionBy("conv_id", "turn").orderBy("seq")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    resets = F.col("kind").isin("message", "edit", "regenerate").cast("int")
    versions = log.withColumns(
        {
            "version": F.sum(resets).over(turn.rowsBetween(Window.unboundedPreceding, 0)),
            "last": F.sum(resets).over(whole),
            "role": F.first("role", ignorenulls=True).over(whole),
        }
    )
    live = versions.filter("version = last")
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    text = F.array_join(F.transform(pieces, lambda x: x["text"]), "")
    return live.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and the loss mask of each conversation from its messages (conv_id, turn, role, text)."""
    own = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = F.transform(
        F.array_sort(F.collect_list(own)),
        lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")),
    )
    talks = messages.groupBy("conv_id").agg(parts.alias("parts"))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        span = F.array(F.struct(start.alias("start"), F.char_length(p["body"]).alias("length")))
        mask = F.when(p["role"] == "assistant", F.concat(acc["mask"], span)).otherwise(acc["mask"])
        return F.struct((start + F.char_length(p["body"]) + F.lit(len(END))).alias("at"), mask.alias("mask"))

    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return talks.select("conv_id", formatted.alias("formatted"), F.aggregate("parts", zero, step, lambda acc: acc["mask"]).alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) read back from a rendered conversation."""
    pieces = F.split(formatted, "<\\|im_end\\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(START) + 1))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(inner, F.char_length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"], m["length"]))), "")
