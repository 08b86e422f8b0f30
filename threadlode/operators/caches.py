"""Labels, statuses and reasons that a provider gives once per content, kept by content hash.

Each function returns all rows with what is known, what the provider gave for the misses, or the fallback, and says which
(``way``). Rows of way ``llm`` (or ``ok``) are what the caller appends to the cache; fallbacks are never kept, so they are
tried again. Only misses reach the provider, as one prompt a row, and only once: replies are kept in a ledger before they are used. A prompt holds at most
``SHOWN_NOTES`` notes of a theme, but for a status, which is judged by all of them: that prompt is as long as the theme.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlode.functions.ids import DAY_US
from threadlode.operators.ledger import replies
from threadlode.operators.themes import RECURRING_DAYS, RECURRING_SESSIONS, STALE_DAYS

#: Notes of a theme that a provider is shown.
SHOWN_NOTES = 40
#: A provider of several fields: a prompt in, the fields out.
Fields = Callable[[str], tuple]


def asked(prompts: DataFrame, key: str, provider: Fields, fields: tuple[str, ...], ledger: str | None = None, role: str = "") -> DataFrame:
    """(key, *fields, how) for each of ``prompts(key, prompt)``; how: ok, cold (the provider is cooling down) or error.

    The provider is asked here and now, once per distinct prompt, and its replies are kept in the folder ``ledger`` (``operators.ledger``); what is returned is
    read from there. Without a folder they are kept for this call alone."""
    got = replies(prompts, key, provider, ledger, role)
    said = F.from_json("reply", "array<string>")
    how = F.when(F.col("how").isin("ok", "cold"), F.col("how")).otherwise("error")
    return got.select(key, *[F.get(said, F.lit(k)).alias(c) for k, c in enumerate(fields)], how.alias("how"))


def prompts_of(themes: DataFrame, notes: DataFrame, most: int | None = SHOWN_NOTES, mark: str = "- ") -> DataFrame:
    """(content_hash, prompt): the texts of each theme's first ``most`` notes by id, a line each."""
    member = themes.select("theme_id", "content_hash").join(notes.select("theme_id", "note_id", "text"), "theme_id")
    if most is not None:
        member = member.withColumn("_k", F.row_number().over(Window.partitionBy("theme_id").orderBy("note_id"))).where(F.col("_k") <= most)
    lines = F.array_sort(F.collect_list(F.struct("note_id", F.concat(F.lit(mark), "text").alias("line"))))
    return member.groupBy("content_hash").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def labels(themes: DataFrame, notes: DataFrame, cache: DataFrame, provider: Fields, ledger: str | None = None) -> DataFrame:
    """(theme_id, content_hash, label, summary, way) of ``themes(theme_id, content_hash, label)``, whose own label is the
    fallback; ``cache(content_hash, label, summary)``; way: cached, llm or fallback."""
    own = themes.select("theme_id", "content_hash", F.col("label").alias("fallback"))
    missing = own.join(cache.select("content_hash"), "content_hash", "left_anti")
    got = asked(prompts_of(missing, notes), "content_hash", provider, ("new_label", "new_summary"), ledger, "label")
    rows = own.join(cache.select("content_hash", "label", "summary", F.lit(True).alias("known")), "content_hash", "left").join(got, "content_hash", "left")
    way = F.when(F.col("known"), "cached").when((F.col("how") == "ok") & F.col("new_label").isNotNull(), "llm").otherwise("fallback")
    pick = lambda old, new, other: F.when(way == "cached", F.col(old)).when(way == "llm", F.col(new)).otherwise(other)
    return rows.select("theme_id", "content_hash", pick("label", "new_label", F.col("fallback")).alias("label"), F.coalesce(pick("summary", "new_summary", F.lit("")), F.lit("")).alias("summary"), way.alias("way"))


def statuses(themes: DataFrame, notes: DataFrame, cache: DataFrame, provider: Fields, now_us: int, ledger: str | None = None) -> DataFrame:
    """(theme_id, content_hash, status, verdict, way) of themes with session_count, span_days and last_us.

    Themes that don't recur are unknown, without a call (na). A cached verdict or the provider's (ok) is open or resolved;
    anything else it says counts as open. If it is cooling down a theme is presumed open (heuristic), if it fails unknown
    (error). Open threads that weren't seen for ``STALE_DAYS`` are dormant, which is laid over the verdict and not kept.
    """
    recurring = (F.col("session_count") >= RECURRING_SESSIONS) & (F.col("span_days") >= RECURRING_DAYS)
    own = themes.select("theme_id", "content_hash", F.coalesce(recurring, F.lit(False)).alias("recurring"), (F.col("last_us") < now_us - STALE_DAYS * DAY_US).alias("stale"))
    missing = own.where("recurring").join(cache.select("content_hash"), "content_hash", "left_anti")
    got = asked(prompts_of(missing, notes, None, ""), "content_hash", provider, ("said",), ledger, "status")
    rows = own.join(cache.select("content_hash", F.col("status").alias("known")), "content_hash", "left").join(got, "content_hash", "left")
    said = F.when(F.col("said").isin("open", "resolved"), F.col("said")).otherwise("open")
    verdict = F.when(~F.col("recurring"), None).when(F.col("known").isNotNull(), F.col("known")).when(F.col("how") == "ok", said)
    way = F.when(~F.col("recurring"), "na").when(verdict.isNotNull(), "ok").when(F.col("how") == "error", "error").otherwise("heuristic")
    base = F.when(way.isin("na", "error"), "unknown").otherwise(F.coalesce(verdict, F.lit("open")))
    status = F.when((base == "open") & F.col("stale"), "dormant").otherwise(base)
    return rows.select("theme_id", "content_hash", status.alias("status"), verdict.alias("verdict"), way.alias("way"))


def reasons(told_links: DataFrame, provider: Fields, ledger: str | None = None) -> DataFrame:
    """(link_id, why) of links with their notes' texts: the stored reason, else the provider's, else null."""
    empty = F.length(F.coalesce("why", F.lit(""))) == 0
    prompt = F.concat(F.lit("A: "), "from_text", F.lit("\nB: "), "to_text")
    got = asked(told_links.where(empty).select("link_id", prompt.alias("prompt")), "link_id", provider, ("new_why",), ledger, "reason")
    return told_links.select("link_id", "why").join(got, "link_id", "left").select("link_id", F.when(empty, F.col("new_why")).otherwise(F.col("why")).alias("why"))
