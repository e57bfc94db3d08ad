"""Chat formatting: conversation logs folded into final messages, then rendered for training.

A log holds one row per event: ``conv_id``, ``msg`` (place of the message in its conversation), ``seq`` (order of the
events), ``kind``, ``role``, ``text``.

=============  =====================================================================================
kind           effect
=============  =====================================================================================
``delta``      appends its text to the message (null counts as ``delta``)
``edit``       replaces the message's text; all that later messages held before this event is dropped
``regenerate`` starts the message anew with its text; drops what follows like an edit
``delete``     empties the message; it vanishes unless later events fill it again
=============  =====================================================================================

Everything is a DataFrame expression: one shuffle deals the log out by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column, marks: str = "<#") -> Column:
    """Doubles each backslash and puts one behind each of ``marks``, so no control string survives inside ``text``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit(m + "\\"))
    return out


def unescape(text: Column, marks: str = "<#") -> Column:
    return F.regexp_replace(text, rf"([{marks}])\\|\\(\\)", "$1$2")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, msg, role, text``.

    Null texts are empty. The role is that of the message's first surviving event that has one, else empty. Events of
    one message with equal ``seq`` apply in order of kind and text. Messages whose last event is a ``delete`` vanish.
    An empty log gives no rows; other columns are ignored.
    """
    e = F.struct(
        F.col("seq"),
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("role"),
    )
    dealt = events.select("conv_id", "msg", e.alias("e"), F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")).alias("cut"))
    messages = dealt.repartition("conv_id").groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list("e")).alias("log"), F.max("cut").alias("cut"))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("cut").over(before)
    live = messages.withColumn("cut_before", cut).withColumn(
        "log", F.filter("log", lambda x: F.col("cut_before").isNull() | (x.seq > F.col("cut_before")))
    )
    reset = F.array_max(F.transform("log", lambda x, i: F.when(x.kind != "delta", i).otherwise(0)))
    last = live.filter(F.size("log") > 0).withColumn("tail", F.slice("log", reset + 1, F.size("log")))
    role = F.get(F.filter("log", lambda x: x.role.isNotNull()), F.lit(0)).role
    return last.filter(F.element_at("tail", -1).kind != "delete").select(
        "conv_id",
        "msg",
        F.coalesce(role, F.lit("")).alias("role"),
        F.array_join(F.transform(F.filter("tail", lambda x: x.kind != "delete"), lambda x: x.text), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``formatted`` joins a turn ``### role: text</turn>\\n`` per message in order of ``msg``. ``loss_spans`` has, for
    each message of ``loss_role``: ``turn`` (from 0), ``offset`` in that turn, ``start`` in ``formatted`` and
    ``length``, all in code points, of its escaped text. Null roles and texts are empty.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit("")), "<#:"), F.lit(SEP))
    turns = messages.select("conv_id", "msg", "role", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("msg")
    turns = turns.withColumns(
        {
            "turn": F.row_number().over(order) - 1,
            "start": F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece"),
        }
    )
    span = F.struct("turn", F.length("head").alias("offset"), (F.col("start") + F.length("head")).alias("start"), F.length("body").alias("length"))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x.piece), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == loss_role, span))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, read back: array of ``role, text``."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, rf"(?s)^{OPEN}(.*?){SEP}", 1)
        text = F.substring(piece, F.length(role) + len(OPEN) + len(SEP) + 1, F.length(piece))
        return F.struct(unescape(role, "<#:").alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    pieces = F.split(formatted, CLOSE)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(pieces, s.turn), s.offset + 1, s.length))), "")
