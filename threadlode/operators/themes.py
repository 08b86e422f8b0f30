"""Themes: rollup of their notes, content hash, label and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlode.functions.ids import DAY_US, set_hash
from threadlode.functions.text import fallback_label

RECURRING_SESSIONS, RECURRING_DAYS, STALE_DAYS = 2, 14, 60


def scaled_min_cluster_size(n: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(8), F.floor(n / 400))).cast("int")


def with_text_parts(notes: DataFrame) -> DataFrame:
    """``notes`` with what a rollup takes of a text: ``line_hash`` and ``head``, each of a fixed length at most."""
    return notes.withColumns({"line_hash": F.sha2(F.concat_ws(":", "note_id", "text"), 256), "head": fallback_label(F.col("text"))})


def rollup(notes: DataFrame) -> DataFrame:
    """One row per theme over its notes; those without a theme are noise. Notes that come with their ``with_text_parts`` need no text.

    Only ``note_ids`` is a list; where it isn't read it isn't made, and all else is added up in parts."""
    if "line_hash" not in notes.columns:
        notes = with_text_parts(notes)
    grouped = notes.where("theme_id is not null").groupBy("theme_id").agg(
        F.countDistinct("session_id").alias("session_count"),
        F.countDistinct("source").alias("source_count"),
        F.min("created_us").alias("first_us"),
        F.max("created_us").alias("last_us"),
        F.count("*").alias("n_notes"),
        F.array_sort(F.collect_list("note_id")).alias("note_ids"),
        set_hash(F.col("line_hash")).alias("content_hash"),
        F.min_by("head", "note_id").alias("label"),
    )
    return grouped.withColumn("span_days", F.expr(f"(last_us - first_us) div {DAY_US}"))


def status(theme: DataFrame, now_us: int, known: DataFrame | None = None) -> DataFrame:
    """Adds ``status``. ``known(content_hash, known_status)`` are earlier verdicts; without one a recurring theme is open.

    Not recurring: unknown. Open and not seen for ``STALE_DAYS``: dormant (laid over the verdict, never stored).
    """
    if known is not None:
        theme = theme.join(known, "content_hash", "left")
    else:
        theme = theme.withColumn("known_status", F.lit(None).cast("string"))
    recurring = (F.col("session_count") >= RECURRING_SESSIONS) & (F.col("span_days") >= RECURRING_DAYS)
    verdict = F.when(F.col("known_status").isin("open", "resolved", "dormant"), F.col("known_status")).otherwise("open")
    stale = F.col("last_us") < now_us - STALE_DAYS * DAY_US
    final = F.when(~recurring, "unknown").when((verdict == "open") & stale, "dormant").otherwise(verdict)
    return theme.withColumn("status", final).drop("known_status")


def unfinished(theme: DataFrame, muted: DataFrame | None = None, include_dormant: bool = False) -> DataFrame:
    """Open threads, those that recur most over the longest time first; muted labels left out."""
    wanted = ["open", "dormant"] if include_dormant else ["open"]
    rows = theme.where(F.col("status").isin(wanted))
    if muted is not None:
        rows = rows.join(muted.select("label_lc"), F.lower(F.trim("label")) == F.col("label_lc"), "left_anti")
    return rows.withColumn("score", F.col("session_count") * (F.col("span_days") + 1)).orderBy(F.desc("score"), F.desc("session_count"), "theme_id")
