"""Sessions to notes through a provider, and the provider's stand-in for offline runs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlode.functions.ids import note_id
from threadlode.functions.text import strip
from threadlode.operators.ledger import replies

#: A provider takes a prompt and returns notes (kind, text, span).
Provider = Callable[[str], list[tuple[str, str, str]]]


def first_sentences(prompt: str) -> list[tuple[str, str, str]]:
    """Offline provider: the first sentence of every user message is an idea."""
    found = re.findall(r"^(msg:\d+) \[user\] ([^\n.]{12,200}\.)", prompt, re.M)
    return [("idea", text.strip(), span) for span, text in found]


#: A task gives up after this many failures in a row.
MOST_FAILURES = 5


def distill(prompts: DataFrame, provider: Provider = first_sentences, ledger: str | None = None) -> DataFrame:
    """One row per note of prompts (session_id, prompt), or one with its outcome where there is none or the call failed.

    Outcomes: ``ok``; ``zero_note`` (nothing found, or a reply that isn't valid: done all the same); ``failed``; ``cold``
    (the provider is cooling down: neither this session nor the task's later ones are tried); ``skipped`` (the task gave
    up after ``MOST_FAILURES`` failures in a row). All but the first two stay pending.

    The provider is asked here and now, once per distinct prompt, and its replies are kept in the folder ``ledger`` before they are used: notes and checkpoint come
    from the same replies, and a further call with the same folder asks only for what is pending.
    """
    got = replies(prompts, "session_id", provider, ledger, "distill", stop_when_cold=True, most_failures=MOST_FAILURES)
    said = got.select("session_id", "how", F.from_json("reply", "array<array<string>>").alias("notes"))
    notes = said.where("size(notes) > 0").select("session_id", F.posexplode("notes").alias("pos", "n"))
    part = lambda k, other: F.coalesce(F.get("n", F.lit(k)), F.lit(other))
    kind = F.when(F.length(part(0, "")) > 0, part(0, "")).otherwise("insight")
    found = notes.select("session_id", "pos", kind.alias("kind"), F.get("n", F.lit(1)).alias("text"), part(2, "").alias("span_ref"), F.lit("ok").alias("outcome"))
    outcome = F.when(F.col("how").isin("ok", "invalid"), "zero_note").otherwise(F.col("how"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("kind", "string"), ("text", "string"), ("span_ref", "string"))]
    return found.union(said.where("notes is null or size(notes) = 0").select("session_id", *none, outcome.alias("outcome")))


def outcomes(rows: DataFrame) -> DataFrame:
    """(session_id, outcome) of distilled rows, one per session."""
    return rows.groupBy("session_id").agg(F.min("outcome").alias("outcome"))


def checkpoint(rows: DataFrame, sessions: DataFrame, version: int) -> DataFrame:
    """What to append to the checkpoint table: sessions that are done, with the content and the version they were done at."""
    done = outcomes(rows).where("outcome in ('ok', 'zero_note')").select("session_id")
    return sessions.join(done, "session_id", "left_semi").select("session_id", "content_hash", F.lit(version).alias("pipeline_version"))


def notes_of(rows: DataFrame, sessions: DataFrame | None = None, version: int | None = None, now: Column | None = None) -> DataFrame:
    """Notes with their ids: blank ones dropped, the first of each id kept.

    With ``sessions(session_id, started_us)`` notes are dated by their session, or by ``now`` where that has no date, and
    with ``version`` they are stamped with the pipeline version.
    """
    kept = rows.where("outcome = 'ok'").withColumn("text", strip(F.col("text"))).where("length(text) > 0").withColumn("note_id", note_id(F.col("session_id"), F.col("text")))
    out = kept.groupBy("note_id").agg(F.min_by(F.struct("session_id", "kind", "text", "span_ref"), "pos").alias("x")).select("note_id", "x.*")
    if sessions is not None:
        dated = sessions.select("session_id", F.coalesce("started_us", now if now is not None else F.lit(None)).cast("long").alias("created_us"))
        out = out.join(dated, "session_id", "left").select(*out.columns, "created_us")
    return out if version is None else out.withColumn("pipeline_version", F.lit(version))
