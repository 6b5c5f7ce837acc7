"""Chat formatting from an event log.  DataFrame functions only.

An event belongs to a conversation and a turn and has a sequence number.  Kinds:
``message`` (a new message with its text), ``delta`` (text streamed onto the
turn's latest message), ``edit`` (replaces that message's text), ``regenerate``
(starts that message again, with the event's text).  The fold keeps, for each
message, the events from its last ``message``/``edit``/``regenerate`` on, and
joins their texts by sequence.  A message's role is the last that any of its
events names, so deltas and edits need not repeat it.

One shuffle by conversation serves the windows, the fold and the rendering.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  A ``<``,
any number of ``\\`` and ``|`` in a text gets one more ``\\``, so no text holds a
marker; taking one away restores it.  In roles, ``\\`` and newline are escaped too.

The loss mask is the rendered text in runs: ``pieces`` of ``(text, loss)`` whose
concatenation is ``formatted``; runs under loss hold an assistant's text each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate")
EVENT = "conv_id", "turn", "seq", "kind", "role", "text"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*)\\|", "<\\\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "<\\\\(\\\\*)\\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    pairs = F.split(unescape(role), "\\\\\\\\", -1)
    return F.array_join(F.transform(pairs, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def messages(events: DataFrame) -> DataFrame:
    """The final ``(conv_id, turn, nth, role, text)`` messages of an event log.

    Null kinds count as ``message``, null texts as empty; a null role names none,
    and a message whose events name none has an empty one.  Equal sequence numbers
    fall in order of kind, role (null first) and text, turns that are equal but for
    null roles too; a repeated ``message`` row is a message of its own.  Events before a turn's first ``message`` form
    message 0 of the turn.
    """
    own = events.select(*EVENT).repartition("conv_id").fillna({"kind": "message", "text": ""})
    order = [F.col("seq").asc_nulls_first(), (F.col("kind") != "message").asc(), "kind", "role", "text"]
    turn = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    message = Window.partitionBy("conv_id", "turn", "nth").orderBy(*order)
    placed = own.withColumn("nth", F.sum((F.col("kind") == "message").cast("int")).over(turn)).withColumn("at", F.row_number().over(message))
    whole = Window.partitionBy("conv_id", "turn", "nth")
    named = F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).over(whole)["role"]
    placed = placed.withColumn("reset", F.max(F.when(F.col("kind").isin(*RESETS), F.col("at"))).over(whole)).withColumn("said", F.coalesce(named, F.lit("")))
    last = placed.filter(F.col("at") >= F.coalesce("reset", F.lit(1)))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return last.groupBy("conv_id", "turn", "nth").agg(F.max("said").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def format_chats(events: DataFrame) -> DataFrame:
    """``(conv_id, formatted, pieces)``, one row per conversation of the event log.

    A null conv_id is one conversation; null turns come first.  An empty log
    gives no row; columns other than those of ``EVENT`` are not read.
    """
    final = messages(events)
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct(F.col("turn"), F.col("nth"), head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
    gathered = final.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
                F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return gathered.select("conv_id", pieces.alias("pieces")).select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_chats(formatted: Column) -> Column:
    """The ``(role, text)`` turns that a formatted conversation holds."""
    segments = F.split(formatted, "<\\|im_start\\|>", -1)
    return F.transform(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        lambda s: F.struct(
            _unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.regexp_replace(F.regexp_replace(s, "^[^\\n]*\\n", ""), "<\\|im_end\\|>\\n$", "")).alias("text"),
        ),
    )


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, all read back from ``formatted`` and ``pieces``."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    return (
        chats.withColumn("turns", read_chats(F.col("formatted")))
        .withColumn("loss_text", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as an event log of plain messages."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
