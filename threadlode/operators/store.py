"""Keyed tables without a table format: classify, merge, check. Results are new DataFrames, never overwrites of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify_upsert(current: DataFrame, incoming: DataFrame, key: str = "session_id", digest: str = "content_hash") -> DataFrame:
    """(key, change): new, changed or unchanged for every incoming row."""
    old = current.select(key, F.col(digest).alias("old"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col(digest), "unchanged").otherwise("changed")
    return incoming.join(old, key, "left").select(key, change.alias("change"))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "session_id") -> DataFrame:
    """``current`` with incoming rows put in the place of those with their key."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def insert_absent(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return current.unionByName(incoming.join(current.select(key), key, "left_anti"))


def latest(log: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key of an append-only log."""
    return log.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def pending(sessions: DataFrame, checkpoint: DataFrame, version: int, cap: int | None = 50) -> DataFrame:
    """Sessions whose present content was not distilled by this version yet: newest first, undated last."""
    done = checkpoint.where(F.col("pipeline_version") >= version).select("session_id", "content_hash")
    rows = sessions.join(done, ["session_id", "content_hash"], "left_anti").orderBy(F.desc_nulls_last("started_us"), "session_id")
    return rows if cap is None else rows.limit(cap)


def orphaned(embeddings: DataFrame, notes: DataFrame) -> DataFrame:
    return embeddings.join(notes.select("note_id"), "note_id", "left_anti").select("note_id")


def dangling(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links of which an end is missing."""
    ids = notes.select("note_id")
    by = lambda end: links.join(ids.withColumnRenamed("note_id", end), end, "left_anti").select("link_id", "from_note", "to_note")
    return by("from_note").union(by("to_note")).distinct()


def report(tables: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows and characters of text by table: name -> (data class, table, text column)."""
    out = None
    for name, (kind, df, column) in tables.items():
        row = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.length(column)), F.lit(0)).cast("long").alias("n_chars")).select(F.lit(name).alias("table_name"), F.lit(kind).alias("data_class"), "n_rows", "n_chars")
        out = row if out is None else out.union(row)
    return out


def upsert_notes(current: DataFrame, incoming: DataFrame, version: int) -> DataFrame:
    """The last write of each note id, stamped with the pipeline version that made it."""
    return upsert(current, incoming.withColumn("pipeline_version", F.lit(version)).select(*current.columns), "note_id")


def lacking_embeddings(notes: DataFrame, embeddings: DataFrame) -> DataFrame:
    return notes.join(embeddings.select("note_id"), "note_id", "left_anti")


def set_embeddings(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(note_id, dim, vec) with the vectors of ``incoming(note_id, vec)`` in single precision in the place of older ones."""
    rows = incoming.select("note_id", F.size("vec").alias("dim"), F.col("vec").cast("array<float>").alias("vec"))
    return upsert(current, rows.select(*current.columns), "note_id")


def all_embeddings(embeddings: DataFrame) -> DataFrame:
    return embeddings.orderBy("note_id")


def replace_for(current: DataFrame, users: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of ``users(user_id)`` replaced by ``incoming``, also where that has none for them; others stay."""
    return current.join(users.select("user_id").distinct(), "user_id", "left_anti").select(*current.columns).unionByName(incoming.join(users.select("user_id").distinct(), "user_id", "left_semi").select(*current.columns))


def write_for_users(df: DataFrame, path: str) -> None:
    """Replace the users in ``df`` in a table partitioned by user_id, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id").parquet(path)


def set_meta(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current, incoming.select("key", "value"), "key")


#: Columns of a model's health but for its keys; all count as 0 where they aren't given, except est_rate.
HEALTH = ("cooldown_until", "rung", "consecutive", "est_rate", "last_success", "last_call", "calls", "sent_bytes", "recv_bytes")


def merge_health(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of (provider, model, *HEALTH) with those of ``incoming`` put in, which may lack columns or hold nulls."""
    types = dict(current.dtypes)
    given = lambda c: F.col(c).cast(types[c]) if c in incoming.columns else F.lit(None).cast(types[c])
    full = incoming.select("provider", "model", *[(given(c) if c == "est_rate" else F.coalesce(given(c), F.lit(0).cast(types[c]))).alias(c) for c in HEALTH])
    return current.join(full.select("provider", "model"), ["provider", "model"], "left_anti").select("provider", "model", *HEALTH).union(full)


def llm_traffic(health: DataFrame) -> DataFrame:
    """Models that were called, most often called first."""
    return health.where("calls > 0").select("provider", "model", "calls", "sent_bytes", "recv_bytes").orderBy(F.desc("calls"), "provider", "model")


def rebuild_derived(tables: dict[str, tuple[str, DataFrame]], meta: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """All tables (name -> class, rows) with the derived ones emptied, the meta table without its last refresh, and what
    was discarded: (table_name, n_rows). Raw tables and judgments stay as they are."""
    after = {name: df.limit(0) if kind == "derived" else df for name, (kind, df) in tables.items()}
    gone = None
    for name, (kind, df) in sorted(tables.items()):
        if kind == "derived":
            row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            gone = row if gone is None else gone.union(row)
    return after, meta.where("key <> 'last_refresh'"), gone
