"""What a dashboard shows, as tables, and any of them as one JSON text a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlode.functions.vectors import nearest
from threadlode.operators import links as link_ops
from threadlode.plans.lenses import day

SEARCH_NOTES, ARCS, NOW = 12, 12, 3


def emitted(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as a JSON object with its columns in order; nulls are left out."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))


def themes_data(themes: DataFrame, muted: DataFrame) -> DataFrame:
    mark = muted.select("label_lc", F.lit(True).alias("_m"))
    rows = themes.withColumn("label_lc", F.lower("label")).join(mark, "label_lc", "left")
    return rows.select("theme_id", "label", "status", "session_count", "source_count", F.size("note_ids").cast("long").alias("n_notes"), day("first_us").alias("first_day"), day("last_us").alias("last_day"), F.coalesce("_m", F.lit(False)).alias("is_muted"))


def sorted_themes(data: DataFrame, by: str = "sessions", status: str = "all", limit: int | None = None) -> DataFrame:
    """``themes_data`` as a client shows it: muted ones only under all and muted; by sessions, notes or last day."""
    keep = {"all": F.lit(True), "muted": F.col("is_muted")}.get(status, (F.col("status") == status) & ~F.col("is_muted"))
    first = F.desc({"notes": "n_notes", "recent": "last_day"}.get(by, "session_count"))
    rows = data.where(keep).orderBy(first, F.desc("session_count"), "theme_id")
    return rows if limit is None else rows.limit(limit)


def shown_arcs(arcs: DataFrame, limit: int = ARCS) -> DataFrame:
    return arcs.orderBy("first_us", "theme_id").limit(limit)


def links_data(links: DataFrame, notes: DataFrame, top: int = link_ops.TOP) -> DataFrame:
    """Edges between themes over the best links: how many, the greatest weight, and that link's two texts and reason."""
    pairs = link_ops.theme_pairs(link_ops.with_notes(link_ops.best(links, top), notes).select(*links.columns), top)
    told = link_ops.with_notes(links, notes).select(F.col("link_id").alias("sample_link"), F.substring("from_text", 1, 200).alias("from_text"), "from_source", F.substring("to_text", 1, 200).alias("to_text"), "to_source", "why")
    return pairs.join(told, "sample_link").select("theme_a", "theme_b", "n_links", "max_weight", "from_text", "from_source", "to_text", "to_source", "why")


def proposals_data(proposals: DataFrame) -> DataFrame:
    return proposals.select("proposal_id", "title", "feasibility", "outcome", "reject_reason", "rated_via", "rating_note")


def digests_data(digests: DataFrame, items: DataFrame) -> DataFrame:
    """(digest_id, n, kind, ref, snapshot, outcome): all items; a digest without any is left out unless it is the last, which
    then has one row without an item."""
    last = digests.agg(F.max("digest_id").alias("_last"))
    shown = digests.select("digest_id").join(F.broadcast(last)).join(items.select("digest_id", "n", "kind", "ref", "snapshot", "outcome"), "digest_id", "left")  # one row
    return shown.where("n is not null or digest_id = _last").drop("_last")


def search_notes(notes: DataFrame, themes: DataFrame, query, k: int = SEARCH_NOTES) -> DataFrame:
    """The nearest notes with the theme that holds them: of several the last in order of sessions, then id."""
    holder = themes.select("theme_id", "label", "session_count", F.explode("note_ids").alias("note_id"))
    found = nearest(notes, query, k).join(notes.select("note_id", "text", "kind", "source", "created_us"), "note_id").join(holder, "note_id", "left")
    one = Window.partitionBy("note_id").orderBy("session_count", F.desc("theme_id"))
    rows = found.withColumn("_k", F.row_number().over(one)).where("_k = 1")
    return rows.select("note_id", F.substring("text", 1, 220).alias("text"), "kind", "source", day("created_us").alias("date"), F.round("score", 3).alias("score"), "theme_id", F.col("label").alias("theme_label"))


def now_view(themes: DataFrame, links: DataFrame, notes: DataFrame, warnings: DataFrame) -> DataFrame:
    """(branch, n, line): how many themes, the first open loops, the freshest bridges, and what is to be said of the last
    refresh."""
    count = themes.agg(F.count("*").alias("c")).select(F.lit(0).alias("branch"), F.lit(1).alias("n"), F.concat(F.lit("themes: "), F.col("c").cast("string")).alias("line"))
    numbered = lambda df, *order: df.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  a few rows
    loops = themes.where(F.col("status").isin("open", "dormant")).orderBy(F.desc("session_count"), "theme_id").limit(NOW)
    loops = numbered(loops, F.desc("session_count"), "theme_id").select(F.lit(1).alias("branch"), "n", F.concat("label", F.lit("  ["), "status", F.lit("] · "), F.col("session_count").cast("string"), F.lit(" sessions")).alias("line"))
    top = link_ops.with_notes(link_ops.best(links, NOW), notes)
    bridges = numbered(top, F.desc("weight"), "from_note", "to_note").select(F.lit(2).alias("branch"), "n", F.concat(F.substring("from_text", 1, 52), F.lit(" ↔ "), F.substring("to_text", 1, 52)).alias("line"))
    told = numbered(warnings, "warning").select(F.lit(3).alias("branch"), "n", F.col("warning").alias("line"))
    return count.union(loops).union(bridges).union(told)


def status_report(storage: DataFrame) -> DataFrame:
    """(data_class, n_rows, n_chars) over ``store.report``."""
    return storage.groupBy("data_class").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def refresh_warnings(meta: DataFrame) -> DataFrame:
    """(warning): none if the last refresh was sound or its record can't be read; else that there was none yet, or that it was degraded."""
    return meta.where("key = 'last_refresh'").agg(F.max("value").alias("v")).select(warning_of(F.col("v")).alias("warning")).where("warning is not null")


def warning_of(record: Column) -> Column:
    """What to warn of, given the record of the last refresh, or null."""
    return F.when(F.coalesce(record, F.lit("")) == "", NEVER).when(json_field(record, "degraded") == "true", DEGRADED)


def warnings_by_user(users: DataFrame, meta: DataFrame) -> DataFrame:
    """(user_id, warning) of the users with something to warn of; ``meta(user_id, key, value)``."""
    last = meta.where("key = 'last_refresh'").groupBy("user_id").agg(F.max("value").alias("v"))
    return users.select("user_id").join(last, "user_id", "left").select("user_id", warning_of(F.col("v")).alias("warning")).where("warning is not null")


#: The two warnings.
NEVER = "no refresh has run yet — recall sees only what's been distilled"
DEGRADED = "last refresh was degraded by provider rate limits — some labels/statuses may be incomplete"
