"""The read side: recall, ask, connections, unfinished threads, topic search, provenance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlode.functions.text import excerpt, word_set
from threadlode.functions.vectors import nearest
from threadlode.operators import links as link_ops
from threadlode.session import materialize

SEARCH_K, HOT = 25, 0.15
#: Commits that hits are compared with by plans that take only the newest, and the words one has to share.
COMMITS, SHARED_WORDS = 300, 3
#: Sentences that users read.
IMPLEMENTED, ADDRESSED = "possibly implemented in ", " · a local commit may have addressed this"
FOUND, NOT_FOUND = "Relevant prior context (query: “{}”):\n\n", "no prior context found for “{}”"
CAUTION = "Treat this as prior context, not ground truth — verify against the current code."


def day(us: str):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def note_source(source: str, us: str, session: str):
    date = F.when(F.col(us).isNotNull(), F.concat(F.lit(" · "), day(us))).otherwise("")
    return F.concat(F.col(source), date, F.lit(" · session "), F.col(session))


def hot_notes(notes: DataFrame, query: Sequence[float], k: int = SEARCH_K, floor: float = HOT) -> DataFrame:
    return nearest(notes, query, k).where(F.col("score") > floor)


def recall_themes(hot: DataFrame, notes: DataFrame, themes: DataFrame) -> DataFrame:
    """Themes with at least one hot note, by the sum of their scores."""
    member = themes.select("theme_id", "label", "status", "first_us", "last_us", F.posexplode("note_ids").alias("pos", "note_id"))
    rows = member.join(hot, "note_id").join(notes.select("note_id", "text", "source", "created_us", "session_id"), "note_id")
    rows = rows.withColumn("src", note_source("source", "created_us", "session_id"))
    grouped = rows.groupBy("theme_id", "label", "status", "first_us", "last_us").agg(
        F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n"), F.min_by("text", "pos").alias("example"),
        F.array_sort(F.collect_set("src")).alias("sources"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "note_id"))), lambda x: x["note_id"]).alias("cites"),
    )
    why = F.concat(F.col("n").cast("string"), F.lit(" of your prior notes match — e.g. “"), F.col("example"), F.lit("”; thread status: "), F.col("status"))
    span = F.concat(day("first_us"), F.lit("→"), day("last_us"))
    return grouped.select(F.lit("theme").alias("kind"), F.col("theme_id").alias("ref"), F.col("label").alias("title"), F.col("example").alias("summary"), why.alias("why"), "score", "status", span.alias("date_range"), "sources", "cites")


def recall_bridges(hot: DataFrame, notes: DataFrame, links: DataFrame, top: int = link_ops.TOP) -> DataFrame:
    """Of the best links those with a hot end, by weight plus the hotter end's score; a stored reason (``why``) is told."""
    end = lambda c, s: hot.select(F.col("note_id").alias(c), F.col("score").alias(s))
    rows = link_ops.with_notes(link_ops.best(links, top), notes).join(end("from_note", "s1"), "from_note", "left").join(end("to_note", "s2"), "to_note", "left")
    rows = rows.where("s1 is not null or s2 is not null")
    tools = F.when(F.col("from_source") == F.col("to_source"), F.col("from_source")).otherwise(F.concat(F.least("from_source", "to_source"), F.lit(" ↔ "), F.greatest("from_source", "to_source")))
    apart = F.when(F.col("gap_days") >= 60, F.concat(F.lit(" · "), F.expr("gap_days div 30").cast("string"), F.lit(" months apart"))).otherwise("")
    score = F.round(F.col("weight") + F.greatest(F.coalesce("s1", F.lit(0.0)), F.coalesce("s2", F.lit(0.0))), 6)
    return rows.select(
        F.lit("connection").alias("kind"), F.col("link_id").alias("ref"), F.concat(F.substring("from_text", 1, 60), F.lit(" ↔ "), F.substring("to_text", 1, 60)).alias("title"),
        F.col("to_text").alias("summary"), F.when(F.length("why") > 0, F.col("why")).otherwise(F.concat(F.lit("bridge across "), tools, apart)).alias("why"), score.alias("score"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("date_range"),
        F.array(note_source("from_source", "from_created_us", "from_session_id"), note_source("to_source", "to_created_us", "to_session_id")).alias("sources"), F.array("from_note", "to_note").alias("cites"),
    )


def recall_notes(hot: DataFrame, notes: DataFrame, cited: DataFrame, room) -> DataFrame:
    """Hot notes that no hit cites yet, best first, as many as ``room`` (a one-row table) allows."""
    free = hot.join(cited, "note_id", "left_anti").join(notes.select("note_id", "text", "kind", "source", "created_us", "session_id"), "note_id")
    ranked = free.withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), "note_id")))  # at most SEARCH_K rows
    kept = ranked.join(F.broadcast(room)).where("k <= room")  # one row
    return kept.select(
        F.lit("note").alias("kind"), F.col("note_id").alias("ref"), F.substring("text", 1, 70).alias("title"), F.col("text").alias("summary"), F.concat(F.lit("direct match ("), F.col("kind"), F.lit(")")).alias("why"),
        F.round(F.col("score") * 0.8, 6).alias("score"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("date_range"), F.array(note_source("source", "created_us", "session_id")).alias("sources"), F.array("note_id").alias("cites"),
    )


def recall(notes: DataFrame, themes: DataFrame, links: DataFrame, query: Sequence[float], limit: int = 5, commits: DataFrame | None = None, told: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best ``limit`` hits of three kinds. If a bridge exists and none made it, the best one takes the last place.

    With ``commits(pos, sha, message)``, newest first by pos, a hit that shares enough words with one points to it
    (``git_ref``), and an open one says so in its reason.

    Everything after the nearest-neighbour scan works on at most 25 notes and the best 200 links. Where ``notes`` has no texts,
    ``told`` gives for some of their ids (note_id) the notes with texts.
    """
    hot = materialize(hot_notes(notes, query), "hot-notes")  # each of these is used several times, and small
    if told is not None:
        notes = told(hot.select("note_id").union(link_ops.ends(link_ops.best(links, link_ops.TOP))))
    best_themes = materialize(recall_themes(hot, notes, themes).orderBy(F.desc("score"), "ref").limit(max(1, limit - 1)), "hot-themes")
    bridges = materialize(recall_bridges(hot, notes, links), "hot-bridges")
    both = best_themes.unionByName(bridges)
    cited = both.select(F.explode("cites").alias("note_id")).distinct()
    room = both.agg((F.lit(limit + 2) - F.count("*")).alias("room"))
    branch = lambda df, n: df.withColumn("branch", F.lit(n))
    hits = branch(best_themes, 0).unionByName(branch(bridges, 1)).unionByName(branch(recall_notes(hot, notes, cited, room), 2))
    order = Window.orderBy(F.desc("score"), "branch", "ref")  # some 210 rows at most
    ranked = hits.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    first_bridge = F.min(F.when(F.col("kind") == "connection", F.col("k"))).over(Window.partitionBy(F.lit(0)))
    ranked = ranked.withColumn("bridge", first_bridge)
    swap = (F.col("n") > limit) & (F.col("bridge") > limit)
    taken = ranked.where(((F.col("k") <= limit) & ~(F.coalesce(swap, F.lit(False)) & (F.col("k") == limit))) | (F.coalesce(swap, F.lit(False)) & (F.col("k") == F.col("bridge"))))
    hits = taken.withColumn("rank", F.least("k", F.lit(limit)).cast("int")).select("rank", "kind", "ref", "title", "summary", "why", "score", "status", "date_range", "sources", "cites")
    return hits.withColumn("git_ref", F.lit(None).cast("string")) if commits is None else with_commits(hits, commits)


def with_commits(hits: DataFrame, commits: DataFrame) -> DataFrame:
    """``hits``, a bounded number, with ``git_ref``, a pointer to verify and not a claim.

    All of ``commits`` is read, twice and where it lies: the hits' words are sent to it, then the positions found. Of its
    messages neither texts nor words are shuffled, only how many words one shares with a hit.
    """
    hits = materialize(hits, "hits")
    found = most_shared(F.broadcast(with_words(hits, "title", "summary")), with_words(commits, "message"), SHARED_WORDS).select("ref", "pos")
    told = commits.join(F.broadcast(found), "pos").select("ref", F.concat(F.lit(IMPLEMENTED), "sha", F.lit(" — “"), "message", F.lit("”")).alias("git_ref"))
    rows = hits.join(told, "ref", "left")
    why = F.when((F.col("status") == "open") & F.col("git_ref").isNotNull(), F.concat("why", F.lit(ADDRESSED))).otherwise(F.col("why"))
    return rows.withColumn("why", why).select(*hits.columns, "git_ref")


def handoff(hits: DataFrame, query: str) -> DataFrame:
    """One row: a text block to paste elsewhere."""
    status = F.when(F.col("status").isNotNull(), F.concat(F.lit(" ["), F.col("status"), F.lit("]"))).otherwise("")
    git = F.coalesce(F.concat(F.lit("\n   "), "git_ref"), F.lit(""))
    block = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), status, F.lit(" — "), F.col("summary"), F.lit("\n   why: "), F.col("why"), git, F.lit("\n   sources: "), F.array_join("sources", "; "))
    g = hits.select("rank", block.alias("block"), "cites").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cites")))).alias("c"))
    text = F.concat(F.lit(FOUND.format(query)), F.array_join(F.transform("b", lambda x: x["block"]), "\n"), F.lit(f"\n\n{CAUTION}\ncites: "), F.array_join("c", ", "))
    return g.select(F.when(F.size("b") > 0, text).otherwise(F.lit(NOT_FOUND.format(query))).alias("handoff"))


def ask(notes: DataFrame, themes: DataFrame, query: Sequence[float]) -> DataFrame:
    """The theme of the single nearest note: the first by id that holds it."""
    top = nearest(notes, query, 1)
    member = themes.select("theme_id", "label", "status", "session_count", F.explode("note_ids").alias("note_id"))
    return top.join(member, "note_id").orderBy("theme_id").limit(1).select("theme_id", "label", "status", "session_count")


def topic_themes(notes: DataFrame, themes: DataFrame, muted: DataFrame, query: Sequence[float] | None = None, k: int = 50, limit: int = 10) -> DataFrame:
    """Unmuted themes by how many of the ``k`` nearest notes they hold; without a query all, by their sessions."""
    if query is None:
        heard = themes.join(muted, F.lower(F.trim("label")) == F.col("label_lc"), "left_anti").withColumn("n_hits", F.lit(None).cast("long"))
        return heard.orderBy(F.desc("session_count"), "theme_id").limit(limit).select("theme_id", "label", "status", "session_count", "n_hits")
    member = themes.select("theme_id", "label", "status", "session_count", F.explode("note_ids").alias("note_id"))
    found = nearest(notes, query, k).join(member, "note_id").join(muted, F.lower(F.trim("label")) == F.col("label_lc"), "left_anti")
    return found.groupBy("theme_id", "label", "status", "session_count").agg(F.count("*").alias("n_hits")).orderBy(F.desc("n_hits"), "theme_id").limit(limit)


def find_connections(notes: DataFrame, links: DataFrame, query: Sequence[float], k: int = 50, limit: int = 10, told: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links near a topic: cut to ``limit`` before links whose notes are gone are dropped. ``told`` as in ``recall``."""
    hits = nearest(notes, query, k).select("note_id")
    end = lambda c: hits.select(F.col("note_id").alias(c), F.lit(True).alias(f"is_{c}"))
    near = links.join(end("from_note"), "from_note", "left").join(end("to_note"), "to_note", "left").where("is_from_note or is_to_note")
    near = link_ops.best(near, limit)
    rows = link_ops.with_notes(near, notes if told is None else told(link_ops.ends(near)))
    return rows.select("link_id", F.substring("from_text", 1, 400).alias("from_text"), F.substring("to_text", 1, 400).alias("to_text"), F.round("weight", 3).alias("weight"))


def connections(notes: DataFrame, links: DataFrame, limit: int = 20, theme: str | None = None) -> DataFrame:
    """The best links, or the best of those that ``theme`` has a part in."""
    own = links if theme is None else links.where((F.col("from_theme") == theme) | (F.col("to_theme") == theme))
    rows = link_ops.with_notes(link_ops.best(own, limit), notes)
    return rows.select("link_id", "from_note", "to_note", "from_text", "to_text", "from_source", "to_source", "weight", "gap_days", "why")


def label_search(themes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Themes whose label contains any word of the query longer than one character."""
    words = sorted({w for w in query.lower().split() if len(w) > 1})
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("label"), w)) if words else F.lit(False)
    return themes.where(hit).orderBy("theme_id").limit(limit).select("theme_id", "label", "status", "session_count")


def show_source(notes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Where notes come from: (note_id, session_id, title, excerpt) of notes (note_id, session_id, span_ref)."""
    rows = notes.join(sessions.select("session_id", "title", "messages"), "session_id")
    return rows.select("note_id", "session_id", "title", excerpt(F.col("span_ref"), F.col("messages")).alias("excerpt"))


def commit_references(hits: DataFrame, commits: DataFrame, least: int = SHARED_WORDS) -> DataFrame:
    """For each hit (ref, words) the earliest commit (pos, sha, message) with the most words in common, if at least ``least``."""
    best = most_shared(hits, commits, least)
    return best.join(commits.select("pos", "message"), "pos").select("ref", "pos", "overlap", F.substring("message", 1, 60).alias("message"))


def most_shared(hits: DataFrame, commits: DataFrame, least: int) -> DataFrame:
    """(ref, pos, overlap) of those commits. A pos that is null comes last.

    The join is on words, so only pairs with a word in common meet; their number is what the overlap counts.
    """
    word = lambda df, *keep: df.select(*keep, F.explode("words").alias("word"))
    shared = word(hits, "ref").join(word(commits, "pos"), "word").groupBy("ref", "pos").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    return shared.groupBy("ref").agg(F.min_by("pos", F.struct(-F.col("overlap"), F.col("pos").isNull(), "pos")).alias("pos"), F.max("overlap").alias("overlap"))


def with_words(rows: DataFrame, *text: str) -> DataFrame:
    return rows.withColumn("words", word_set(F.concat_ws(" ", *text)))
