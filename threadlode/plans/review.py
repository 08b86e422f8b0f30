"""Proposals, digests and dashboard aggregates over the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlode.functions.ids import DAY_US, members_hash
from threadlode.functions.vectors import cosine
from threadlode.operators import links as link_ops
from threadlode.operators import themes as theme_ops

CONNECTIONS, NUDGES, COOLDOWN, DISMISSED = 2, 2, 2, 2
PARAPHRASE = 0.90


def hit_rate(kept: Column, dismissed: Column) -> Column:
    """Whole percent of judged proposals that were kept; null if none was judged."""
    return F.floor(100 * kept / F.nullif(kept + dismissed, F.lit(0))).cast("long")


def outcome_counts(proposals: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return proposals.agg(F.count("*").alias("total"), n("kept").alias("kept"), n("dismissed").alias("dismissed")).withColumn("hit_rate", hit_rate(F.col("kept"), F.col("dismissed")))


def rejection_mix(proposals: DataFrame) -> DataFrame:
    return proposals.where("outcome = 'rejected'").groupBy("reject_reason").agg(F.count("*").alias("n"))


def ranked_proposals(proposals: DataFrame, outcome: str = "pending", limit: int = 20) -> DataFrame:
    """Most feasible first; unrated ones stand between 2 and 3."""
    score = F.coalesce(F.col("feasibility").cast("double"), F.lit(2.5))
    return proposals.where(F.col("outcome") == outcome).withColumn("rank_score", score).orderBy(F.desc("rank_score"), "doc_id").limit(limit).select("proposal_id", "title", "rank_score")


def candidates(links: DataFrame, notes: DataFrame, themes: DataFrame, used: DataFrame, muted: DataFrame, limit: int = 10) -> DataFrame:
    """Material for new proposals: the best links, then open unmuted threads, whose material was not ``used(source_hash)``."""
    rows = link_ops.with_notes(link_ops.best(links, 2 * limit), notes)
    line = lambda p: F.concat_ws(":", f"{p}_note", f"{p}_text")
    by_link = rows.select(F.lit(0).alias("branch"), F.lit("connection").alias("kind"), F.col("link_id").alias("ref"), members_hash(F.array(F.sha2(line("from"), 256), F.sha2(line("to"), 256))).alias("source_hash"), F.col("weight").alias("score"))
    open_ = theme_ops.unfinished(themes, muted)
    by_theme = open_.select(F.lit(1).alias("branch"), F.lit("thread").alias("kind"), F.col("theme_id").alias("ref"), F.col("content_hash").alias("source_hash"), F.col("score").cast("double").alias("score"))
    fresh = by_link.union(by_theme).join(used.select("source_hash"), "source_hash", "left_anti")
    return fresh.orderBy("branch", F.desc("score"), "ref").limit(limit).select("kind", "ref", "source_hash", "score")


def novelty(proposals: DataFrame, grounds: DataFrame) -> DataFrame:
    """(proposal_id, novelty_sim, is_paraphrase) from (proposal_id, vec) and grounding notes (proposal_id, note_vec)."""
    sim = F.round(F.max(cosine(F.col("vec"), F.col("note_vec"))), 6)
    best = proposals.join(grounds, "proposal_id", "left").groupBy("proposal_id").agg(sim.alias("novelty_sim"))
    return best.withColumn("is_paraphrase", F.coalesce(F.col("novelty_sim") > PARAPHRASE, F.lit(False)))


def dismissed_themes(log: DataFrame, least: int = DISMISSED) -> DataFrame:
    return log.where("outcome = 'dismissed'").groupBy("theme_ref").agg(F.count("*").alias("n_dismissed")).where(F.col("n_dismissed") >= least)


def recent_nudges(log: DataFrame, digests: int = COOLDOWN) -> DataFrame:
    """Themes nudged in the last digests."""
    last = log.select("digest_id").distinct().orderBy(F.desc("digest_id")).limit(digests)
    return log.where("kind = 'nudge'").join(F.broadcast(last), "digest_id", "left_semi").select("theme_ref").distinct()


def dead_themes(themes: DataFrame, muted: DataFrame, log: DataFrame) -> DataFrame:
    """(theme_ref) of themes that were dismissed too often or whose label is muted."""
    silent = themes.join(muted.select("label_lc"), F.lower(F.trim("label")) == F.col("label_lc"), "left_semi").select(F.col("theme_id").alias("theme_ref"))
    return dismissed_themes(log).select("theme_ref").union(silent).distinct()


def digest_connections(links: DataFrame, notes: DataFrame, shown: DataFrame, blocked: DataFrame, budget: int = CONNECTIONS) -> DataFrame:
    """Never-shown links of the best 100 of which at least one theme is live; shown ones leave after the cut to 100."""
    fresh = link_ops.best(links, 100).join(shown.select(F.col("ref").alias("link_id")), "link_id", "left_anti")
    end = lambda c: blocked.select(F.col("theme_ref").alias(c), F.lit(True).alias(f"{c}_blocked"))
    rows = fresh.join(end("from_theme"), "from_theme", "left").join(end("to_theme"), "to_theme", "left")
    live = (F.col("from_theme").isNotNull() & F.col("from_theme_blocked").isNull()) | (F.col("to_theme").isNotNull() & F.col("to_theme_blocked").isNull())
    told = link_ops.with_notes(rows.where(live), notes)
    k = F.row_number().over(Window.orderBy(F.desc("weight"), "from_note", "to_note"))  # at most 100 rows
    snapshot = F.concat(F.substring("from_text", 1, 120), F.lit(" ↔ "), F.substring("to_text", 1, 120))
    return told.withColumn("k", k).where(F.col("k") <= budget).select(F.lit("connection").alias("kind"), F.col("link_id").alias("ref"), F.col("from_theme").alias("theme_ref"), snapshot.alias("snapshot"), "k")


def digest_nudges(themes: DataFrame, muted: DataFrame, blocked: DataFrame, recent: DataFrame, budget: int = NUDGES) -> DataFrame:
    """Open threads that were not nudged lately."""
    rows = theme_ops.unfinished(themes, muted).join(blocked.select(F.col("theme_ref").alias("theme_id")), "theme_id", "left_anti").join(recent.select(F.col("theme_ref").alias("theme_id")), "theme_id", "left_anti")
    top = rows.orderBy(F.desc("score"), F.desc("session_count"), "theme_id").limit(budget)
    k = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("session_count"), "theme_id"))  # ``budget`` rows
    return top.withColumn("k", k).select(F.lit("nudge").alias("kind"), F.col("theme_id").alias("ref"), F.col("theme_id").alias("theme_ref"), F.substring("label", 1, 200).alias("snapshot"), "k")


def digest_items(connections: DataFrame, nudges: DataFrame, proposals: DataFrame, include_proposal: bool = True) -> DataFrame:
    """All items of a digest, numbered from 1: connections, nudges, then one fresh proposal."""
    parts = connections.withColumn("branch", F.lit(0)).unionByName(nudges.withColumn("branch", F.lit(1)))
    if include_proposal:
        one = ranked_proposals(proposals, limit=1)
        parts = parts.unionByName(one.select(F.lit("proposal").alias("kind"), F.col("proposal_id").alias("ref"), F.lit(None).cast("string").alias("theme_ref"), F.substring("title", 1, 200).alias("snapshot"), F.lit(1).alias("k"), F.lit(2).alias("branch")))
    n = F.row_number().over(Window.orderBy("branch", "k"))  # at most five rows
    return parts.withColumn("n", n.cast("int")).select("n", "kind", "ref", "theme_ref", "snapshot", F.lit("shown").alias("outcome"))


def digest_due(log: DataFrame, now_us: int, days: int = 7) -> DataFrame:
    last = log.agg(F.max("ts_us").alias("last_us"))
    return last.select("last_us", F.coalesce(F.lit(now_us) - F.col("last_us") >= days * DAY_US, F.lit(True)).alias("is_due"))


def timeline_weeks(notes: DataFrame) -> DataFrame:
    """Notes by ISO week and source; undated ones are left out."""
    ts = F.timestamp_micros("created_us")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return notes.where("created_us is not null").groupBy(week.alias("week"), "source").agg(F.count("*").alias("n_notes"))


def timeline_arcs(themes: DataFrame) -> DataFrame:
    rows = themes.where(F.col("status").isin("open", "dormant") & F.col("first_us").isNotNull() & F.col("last_us").isNotNull())
    return rows.select("theme_id", "label", "status", "first_us", "last_us", "session_count").orderBy("first_us", "theme_id")


def bridges(links: DataFrame, notes: DataFrame, themes: DataFrame, limit: int = 20) -> DataFrame:
    label = lambda c: themes.select(F.col("theme_id").alias(c), F.col("label").alias(f"{c}_label"))
    rows = link_ops.with_notes(link_ops.best(links, limit), notes).join(label("from_theme"), "from_theme", "left").join(label("to_theme"), "to_theme", "left")
    return rows.select("link_id", F.round("weight", 3).alias("weight"), "gap_days", F.substring("from_text", 1, 220).alias("from_text"), F.substring("to_text", 1, 220).alias("to_text"), "from_source", "to_source", "from_theme_label", "to_theme_label")


def overview(sessions: DataFrame, notes: DataFrame, themes: DataFrame, links: DataFrame, proposals: DataFrame) -> DataFrame:
    """Long form (metric, value): counts, the status mix, and the hit rate."""
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    rate = outcome_counts(proposals).select(F.lit("hit_rate").alias("metric"), F.col("hit_rate").alias("value"))
    mix = themes.groupBy("status").agg(F.count("*").alias("value")).select(F.concat(F.lit("status:"), "status").alias("metric"), "value")
    sources = notes.groupBy("source").agg(F.countDistinct("session_id").alias("value")).select(F.concat(F.lit("source:"), "source").alias("metric"), "value")
    parts = [one("sessions", sessions), one("notes", notes), one("themes", themes), one("links", links), one("proposals", proposals), rate, mix, sources]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def refresh_stats(distill: DataFrame, labels: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row of counters and whether the run was degraded: provider cold and nothing done, no label by the provider
    though some were needed, or no status verdict though some were tried."""
    d = distill.agg(F.count("*").alias("todo"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "zero_note").alias("zero_note"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "cold").alias("cold"))
    n = lambda v: F.count_if(F.col("way") == v)
    b = labels.agg(n("cached").alias("label_cached"), n("llm").alias("label_llm"), n("fallback").alias("label_fallback"))
    s = statuses.agg(n("ok").alias("status_ok"), n("heuristic").alias("status_heuristic"), n("error").alias("status_error"), n("na").alias("status_na"))
    row = d.join(F.broadcast(b)).join(F.broadcast(s))  # one row each
    return row.withColumn("degraded", F.expr("(cold > 0 and todo > 0 and ok + zero_note = 0) or (label_llm + label_fallback > 0 and label_llm = 0) or (status_ok + status_heuristic + status_error > 0 and status_ok = 0)"))
