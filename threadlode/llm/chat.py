"""Chat formatting by event-sourced reconstruction. DataFrame functions only; no Python on the executors.

The log is a table of events (conv_id, seq, kind, msg, role, text):

* ``delta``: append text to message ``msg``; a message's first event opens it and sets its place.
* ``edit``: the message's text so far is replaced by this text; later deltas append to it.
* ``regenerate``: the message starts anew with this text, and whatever was written before this event to messages
  opened after it is discarded (an answer that is generated again takes the turns after it along).

A message whose events are all discarded is gone. Its role is the last one given to it. Events are ordered by seq, ties by
msg, kind, role and text; a null kind counts as delta, a null text as empty, a null role as empty. A null conv_id is
a conversation of its own; rows that are wholly equal are kept each, as separate events. An empty log gives no rows.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Inside roles and texts every ``<`` with k backslashes and
a ``|`` after it gets one more backslash, so that ``<|`` marks turns only, and undoing it is exact. In roles, line
ends and backslashes are also escaped. The loss mask is the list of (start, length) of assistant texts, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes are split off first, so that one before an n is a line end's wherever it stands."""
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def turn_events(turns: DataFrame) -> DataFrame:
    """The log of plain turns (conv_id, turn, role, text): one delta each, a message of its own even if turns tie."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return turns.select("conv_id", at.alias("seq"), F.lit("delta").alias("kind"), at.alias("msg"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, place (from 1), role, text."""
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    log = Window.partitionBy("conv_id").orderBy("seq", "msg", "kind", "role", "text")
    e = e.withColumn("at", F.row_number().over(log))
    message = Window.partitionBy("conv_id", "msg")
    e = e.withColumn("opened", F.min("at").over(message)).withColumn("reset", F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("at"))).over(message))
    e = e.withColumn("said", F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).over(message)["role"])
    later = Window.partitionBy("conv_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    e = e.withColumn("redone", F.min(F.when(F.col("kind") == "regenerate", F.col("opened"))).over(later))
    alive = e.where("(reset is null or at >= reset) and (redone is null or redone >= opened)")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    messages = alive.groupBy("conv_id", "opened").agg(F.coalesce(F.max("said"), F.lit("")).alias("role"), F.array_join(pieces, "").alias("text"))
    return messages.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("opened")).alias("place"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length)."""
    m = messages.select("conv_id", "place", (F.col("role") == "assistant").alias("learn"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("length", F.length("body")).withColumn("rendered", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("start", (F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0)) + F.length("head")).cast("int"))
    turns = F.array_sort(F.collect_list(F.struct("place", "rendered", "learn", "start", "length")))
    all_turns = m.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return all_turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), control strings restored."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.size(F.split(formatted, r"<\|im_start\|>")))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring_index(F.substr(p, F.instr(p, "\n") + 1), END, 1)).alias("text"),
        ),
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What the formatted texts hold, per conversation, as columns that other engines can check."""
    texts = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    r = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(texts, "").alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
