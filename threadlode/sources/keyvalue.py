"""Chats in editors' key-value stores: SQLite files with ItemTable(key, value) and cursorDiskKV(key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlode.functions.text import strip
from threadlode.sources.transcripts import ASSISTANTS, USERS, _messages, _session, epoch, instant

#: Each editor's folder, and the keys under which its chats may be.
FLAVOURS = {
    "cursor": ("Cursor", (r"aichat.*chatdata",)),
    "windsurf": ("Windsurf", (r"cascade.*(session|conversation|chat)", r"chat\.ChatSessionStore")),
    "antigravity": ("Antigravity", (r"agent.*(session|conversation)", r"chat\.ChatSessionStore")),
}
#: Where a store lies in an editor's folder, and where editors' folders lie in a home or in the root.
STORES = ("User/workspaceStorage/*/state.vscdb", "User/globalStorage/state.vscdb")
HOMES = ("Library/Application Support", ".config")
ROOTS = "mnt/c/Users/*/AppData/Roaming"
_ANY = "role string, type string, author string, text string, content string, message string, timestamp string, createdAt string, created_at string, bubbleId string"
MESSAGES = f"array<struct<{_ANY}>>"
_LISTS = ("conversation", "messages", "bubbles", "turns")
SINGLE = f"id string, composerId string, sessionId string, name string, createdAt string, lastUpdatedAt string, {', '.join(f'{x} {MESSAGES}' for x in _LISTS)}, fullConversationHeadersOnly array<struct<bubbleId string, type string>>"
PAYLOAD = f"tabs array<struct<tabId string, chatTitle string, bubbles {MESSAGES}>>, {SINGLE}"


def editor_roots(flavour: str, home: str, root: str = "/", appdata: str | None = None) -> list[str]:
    """The existing folders of an editor's data on this machine."""
    import glob
    import os

    name = FLAVOURS[flavour][0]
    found = [os.path.join(home, x, name) for x in HOMES] + [os.path.join(p, name) for p in glob.glob(os.path.join(root, ROOTS))]
    return sorted(p for p in found + ([os.path.join(appdata, name)] if appdata else []) if os.path.isdir(p))


def store_paths(roots: list[str]) -> list[str]:
    """The stores within editors' folders, in order."""
    import glob
    import os

    return sorted(p for r in roots for pattern in STORES for p in glob.glob(os.path.join(r, pattern)))


def read_stores(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, tab, key, value) of every readable store of ``paths(path)``; a store that can't be read gives no rows.

    Stores are local files of one machine, so this reader is for a desktop's own data, not for a cluster's.
    """

    def read(batches):
        import shutil
        import sqlite3
        import tempfile
        from pathlib import Path

        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple[str, str, str, str]] = []
                with tempfile.TemporaryDirectory() as tmp:
                    try:
                        for side in ("", "-wal", "-shm"):
                            if Path(path + side).exists():
                                shutil.copy(path + side, f"{tmp}/store{side}")
                        con = sqlite3.connect(f"file:{tmp}/store?mode=ro", uri=True)
                        for table in ("ItemTable", "cursorDiskKV"):
                            try:
                                found = con.execute(f"SELECT key, value FROM {table}").fetchall()
                            except sqlite3.OperationalError:
                                continue
                            rows += [(path, table, str(k), v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)) for k, v in found if v is not None]
                        con.close()
                    except (OSError, sqlite3.DatabaseError):
                        rows = []
                yield pa.record_batch([pa.array(c, pa.string()) for c in (list(zip(*rows, strict=True)) or [[]] * 4)], ["path", "tab", "key", "value"])

    return paths.select("path").mapInArrow(read, "path string, tab string, key string, value string")


def moment(x: Column) -> Column:
    """A time written as a number (seconds or milliseconds) or as ISO text."""
    return F.coalesce(epoch(x.try_cast("double")), instant(x))


def normal(m: Column) -> Column:
    """Messages of any spelling as (role, text, ts): the first spelling of the role and of the time that is given, and the
    first of the text that isn't empty. Texts are stripped; other roles and blank texts are dropped."""

    def one(x: Column) -> Column:
        who = F.coalesce(x["role"], x["type"], x["author"])
        role = F.when(who.isin(*USERS), "user").when(who.isin(*ASSISTANTS), "assistant")
        told = [F.when(F.length(x[n]) > 0, x[n]) for n in ("text", "content", "message")]
        return F.struct(role.alias("role"), strip(F.coalesce(*told)).alias("text"), moment(F.coalesce(x["timestamp"], x["createdAt"], x["created_at"])).alias("ts"))

    return _messages(F.transform(m, one))


def generic_sessions(kv: DataFrame, source: str = "cursor", keys: tuple[str, ...] | None = None) -> DataFrame:
    """Sessions in ItemTable values under the editor's chat keys: a list of tabs, else the first list of messages that one
    session has, else a bare list of messages."""
    wanted = F.lit(False)
    for pattern in keys or FLAVOURS[source][1]:
        wanted = wanted | F.col("key").rlike(f"(?i){pattern}")
    rows = kv.where(wanted & (F.col("tab") == "ItemTable")).withColumn("p", F.from_json("value", PAYLOAD)).withColumn("bare", F.from_json("value", MESSAGES))
    rows = rows.where(F.col("value").rlike(r"^\s*[\[{]"))
    listed = F.col("value").rlike(r"^\s*\[")
    none = F.lit(None).cast("string")
    pick = lambda native, title, m: F.struct(native.alias("native"), title.alias("title"), m.alias("m"))
    tabs = F.transform("p.tabs", lambda t: pick(t["tabId"], t["chatTitle"], t["bubbles"]))
    nonempty = [F.when(F.length(F.col(f"p.{n}")) > 0, F.col(f"p.{n}")) for n in ("composerId", "id", "sessionId")]
    single = F.array(pick(F.coalesce(*nonempty), F.col("p.name"), F.coalesce(*[F.col(f"p.{n}") for n in _LISTS])))
    every = F.when(listed, F.array(pick(none, none, F.col("bare")))).when(F.col("p.tabs").isNotNull(), tabs).otherwise(single)
    e = rows.select("path", "key", F.posexplode(every).alias("pos", "s")).select("path", "key", "pos", "s.*").withColumn("messages", normal(F.col("m"))).where(F.size("messages") > 0)
    native = F.coalesce("native", F.hex(F.xxhash64("path", "key")))  # stable, so reading again changes nothing
    nothing = F.lit(None).cast("timestamp")
    return _dated(e.select("path", F.struct(F.lit(1).alias("way"), "key", "pos").alias("at"), F.lit(source).alias("source"), native.alias("native_id"), "title", "messages", nothing.alias("began"), nothing.alias("left")))


def composer_sessions(kv: DataFrame, source: str = "cursor") -> DataFrame:
    """Sessions under ``composerData:``: inline conversations, or headers whose bubbles are entries of their own."""
    c = kv.where("key like 'composerData:%' and tab = 'cursorDiskKV'").withColumn("p", F.from_json("value", PAYLOAD)).where(F.col("value").rlike(r"^\s*\{"))
    given = F.when(F.length("p.composerId") > 0, F.col("p.composerId"))
    c = c.select("path", "key", F.coalesce(given, F.substring_index("key", "composerData:", -1)).alias("native"), F.col("p.name").alias("title"), moment(F.col("p.createdAt")).alias("began"), moment(F.col("p.lastUpdatedAt")).alias("left"), normal(F.col("p.conversation")).alias("messages"), F.col("p.fullConversationHeadersOnly").alias("heads"))
    about = ["path", "key", "native", "title", "began", "left"]
    inline = c.where(F.size("messages") > 0).select(*about, "messages")
    heads = c.where(F.coalesce(F.size("messages"), F.lit(0)) <= 0).select(*about, F.posexplode("heads").alias("pos", "h"))
    bubble_key = F.concat(F.lit("bubbleId:"), "native", F.lit(":"), F.col("h.bubbleId"))
    bubbles = kv.where("key like 'bubbleId:%' and tab = 'cursorDiskKV'").select("path", F.col("key").alias("bubble"), F.from_json("value", _ANY).alias("b"))
    joined = heads.withColumn("bubble", bubble_key).join(bubbles, ["path", "bubble"])
    typed = F.struct(*[(F.coalesce(F.col(f"b.{n}"), F.col("h.type")) if n == "type" else F.col(f"b.{n}")).alias(n) for n in (x.split()[0] for x in _ANY.split(", "))])
    grouped = joined.groupBy(*about).agg(F.array_sort(F.collect_list(F.struct("pos", typed.alias("m")))).alias("l"))
    listed = grouped.select(*about, normal(F.transform("l", lambda x: x["m"])).alias("messages"))
    rows = inline.unionByName(listed).where(F.size("messages") > 0)
    return _dated(rows.select("path", F.struct(F.lit(0).alias("way"), "key", F.lit(0).alias("pos")).alias("at"), F.lit(source).alias("source"), F.col("native").alias("native_id"), "title", "messages", "began", "left"))


def best_of(sessions: DataFrame) -> DataFrame:
    """Of a session found more than once the version with the most messages; ties to the first path, then the first place."""
    order = Window.partitionBy("id").orderBy(F.desc(F.size("messages")), "path", "at")
    return sessions.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "path", "at")


def editor_sessions(kv: DataFrame, flavour: str) -> DataFrame:
    """All sessions of an editor's stores. Only ``cursor`` has composers; the others keep their transcripts elsewhere, in a
    form without a schema, so that they mostly give no rows."""
    generic = generic_sessions(kv, flavour)
    return best_of(generic.unionByName(composer_sessions(kv)) if flavour == "cursor" else generic)


def read_editor(spark: SparkSession, flavour: str, roots: list[str]) -> DataFrame:
    """Find, open and read an editor's stores; none found gives no rows."""
    paths = spark.createDataFrame([(p,) for p in store_paths(roots)], "path string")
    return editor_sessions(read_stores(spark, paths), flavour)


def detected(spark: SparkSession, homes: dict[str, list[str]]) -> DataFrame:
    """(flavour, n_stores, n_sessions, finding) for each editor of ``homes`` (flavour -> folders): what reading would give."""
    out = None
    for flavour, roots in sorted(homes.items()):
        n = len(store_paths(roots))
        row = read_editor(spark, flavour, roots).agg(F.count("*").alias("n_sessions"))
        told = F.when(F.lit(n) == 0, "no store").when(F.col("n_sessions") == 0, "no chats in its stores: skipped").otherwise("read")
        row = row.select(F.lit(flavour).alias("flavour"), F.lit(n).cast("long").alias("n_stores"), "n_sessions", told.alias("finding"))
        out = row if out is None else out.union(row)
    return out


def _dated(rows: DataFrame) -> DataFrame:
    times = F.transform("messages", lambda x: x["ts"])
    named = F.when(F.length("title") > 0, F.col("title"))
    title = F.substring(F.coalesce(named, F.get("messages", F.lit(0))["text"]), 1, 60)
    full = rows.withColumn("title", title).withColumn("started_at", F.coalesce("began", F.array_min(times))).withColumn("ended_at", F.coalesce("left", F.array_max(times)))
    ids = F.concat_ws(":", "source", "native_id")
    placed = full.select(ids.alias("id"), "path", "at", *[c for c in full.columns if c not in ("path", "at")])
    return _session(placed, "local", "path", "at")
