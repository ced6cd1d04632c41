"""Chat logs: fold events into final messages, render them, read renderings back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import let

#: The marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Kinds of events. A message opens a message of its turn; a delta adds text to it, an edit
#: replaces its text and a regenerate empties it, so that later deltas write it anew.
OPS = ("message", "delta", "edit", "regenerate")

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("chars", T.LongType())])
)


def escape(text: Column) -> Column:
    r"""Make a text free of marks: ``<``, any backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    r"""Undo ``escape``."""
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    r"""Roles end at the line's end, so a backslash and a line feed are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    r"""Undo ``escape_role``: what lies between doubled backslashes has only escaped line feeds."""
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Rebuild the final messages of event-sourced conversations.

    Args:
        events: conv_id, seq, turn, op, role, text; other columns are ignored. seq orders the
            events of a conversation, op is one of ``OPS``. Events of equal seq go by op, in
            the order of ``OPS``, then by role and text. A delta, edit or regenerate concerns
            the message last opened in its turn; if there is none it opens one. A null text
            counts as empty, a null op as message; other ops raise an error.

    Returns:
        conv_id, turn, message (from 0 within a turn), role, text. The role is that of the
        opening event; a null role counts as empty.
    """
    op = F.coalesce(F.col("op"), F.lit("message"))
    rank = F.array_position(F.array(*map(F.lit, OPS)), op)
    rows = events.select(
        "conv_id",
        "turn",
        "seq",
        F.when(rank > 0, rank).otherwise(F.raise_error(F.concat(F.lit("unknown op "), op)).cast("long")).alias("op"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["seq", "op", "role", "text"]
    of_turn = W.partitionBy("conv_id", "turn").orderBy(*order)
    rows = rows.select(
        "*",
        F.row_number().over(of_turn).alias("pos"),
        F.sum(F.when(F.col("op") == 1, 1).otherwise(0)).over(of_turn.rowsBetween(W.unboundedPreceding, 0)).alias("message"),
        F.sum(F.when(F.col("op") != 2, 1).otherwise(0)).over(of_turn.rowsBetween(W.unboundedPreceding, 0)).alias("version"),
    )
    # The events of a message before any opening belong to the first one's place of their own.
    of_message = W.partitionBy("conv_id", "turn", "message")
    rows = rows.select("*", F.max("version").over(of_message).alias("last"))
    told = F.struct("pos", F.when(F.col("op") == 4, F.lit("")).otherwise(F.col("text")).alias("text"))
    return rows.groupBy("conv_id", "turn", "message").agg(
        F.min_by("role", "pos").alias("role"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("version") == F.col("last"), told))), lambda x: x["text"]), ""
        ).alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """Render each conversation's messages in the order of turn and message.

    Returns:
        conv_id, n_turns, formatted, loss_spans. The spans are those of the assistant's escaped
        texts within formatted: start and chars, in code points.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    order = ["turn", "message", "role", "text"]
    rows = messages.select("conv_id", *order, head.alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n")))
    w = W.partitionBy("conv_id").orderBy(*order)
    rows = rows.select(
        "conv_id",
        F.row_number().over(w).alias("pos"),
        "piece",
        F.when(
            F.col("role") == "assistant",
            F.struct(
                (F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head")).alias("start"),
                F.length("body").cast("long").alias("chars"),
            ),
        ).alias("span"),
    )
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list("span")).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The messages of a rendering, unescaped: an array of role and text."""
    parts = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda p, i: i > 0)

    def parse(part: Column) -> Column:
        at = F.instr(part, "\n")
        return F.struct(
            unescape_role(F.left(part, at - 1)).alias("role"),
            unescape(F.substr(part, at + 1, F.length(part) - at - F.lit(len(CLOSE) + 1))).alias("text"),
        )

    return F.transform(parts, parse)


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """What lies under the loss mask of a rendering, unescaped, in order, with nothing between.

    The spans are cut from the text at four bytes a code point, where each is found at once.
    """
    wide = lambda w: F.transform(loss_spans, lambda s: unescape(F.decode(F.substr(w, 4 * s["start"].cast("int") + 1, 4 * s["chars"].cast("int")), "UTF-32")))
    return F.array_join(let(F.encode(formatted, "UTF-32"), wide), "")


def format_chats(events: DataFrame) -> DataFrame:
    """Events to rendered conversations: ``fold_events``, then ``render``.

    An empty table gives an empty one. Repeated rows are events of their own. Texts of any
    length are kept whole; columns besides those named don't matter, whatever their names.
    """
    return render(fold_events(events))
