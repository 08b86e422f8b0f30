"""Readers of chat transcripts. Every reader returns the sessions schema; bad lines are skipped, never fatal.

Parsing is one expression per format over Spark's text reader, with explicit schemas. ``parse_*`` take a DataFrame of
raw text, so the same code serves batch, streams and tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlode import schemas
from threadlode.functions.ids import content_hash, session_id
from threadlode.functions.text import SESSION_MARKERS, is_meta, strip, strip_wrappers

LINE = "source string, native_id string, title string, started_at string, ended_at string, messages array<struct<role: string, text: string, ts: string>>"
LOG_LINE = "type string, isSidechain boolean, timestamp string, message struct<role: string, content: string>"
BLOCKS = "array<struct<type: string, text: string>>"
EXPORT = "array<struct<id: string, conversation_id: string, title: string, create_time: double, current_node: string, mapping: map<string, struct<parent: string, message: struct<author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: array<string>>>>>>>"
#: How roles are written by various tools.
USERS, ASSISTANTS = ("user", "human", "1"), ("ai", "assistant", "bot", "2")


def instant(text: Column) -> Column:
    """ISO text as a timestamp (UTC if it names no zone); null if it is none."""
    return F.try_to_timestamp(text)


def epoch(x: Column) -> Column:
    """Seconds or, beyond 1e12, milliseconds."""
    ms = F.when(x > 1e12, x).otherwise(x * 1000)
    return F.timestamp_millis(ms.cast("long"))


def _session(df: DataFrame, user: str, *others: str) -> DataFrame:
    """From source, native_id, title, started_at, ended_at, messages: the sessions schema, and ``others`` as they are."""
    fields = [f.split()[0] for f in schemas.SESSION.split(", ") if "messages" not in f and ": " not in f]
    out = df.withColumn("id", session_id(F.col("source"), F.col("native_id"))).withColumn("user_id", F.lit(user)).withColumn("content_hash", content_hash(F.col("messages")))
    order = ["id", "user_id", "source", "native_id", "title", "started_at", "ended_at", "messages", "content_hash"]
    assert {*fields} <= {*order}
    return out.select(*order, *others)


def _messages(m: Column) -> Column:
    """User and assistant messages with text."""
    kept = F.filter(m, lambda x: x["role"].isin("user", "assistant") & (F.length(strip(x["text"])) > 0))
    return F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["ts"].alias("ts")))


def parse_jsonl(lines: DataFrame, user: str = "local") -> DataFrame:
    """Normalised sessions, one JSON object a line, in ``lines(value)``."""
    rows = lines.select(F.from_json("value", LINE).alias("r")).select("r.*").where("source is not null and native_id is not null and messages is not null")
    timed = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), instant(x["ts"]).alias("ts")))
    rows = rows.withColumn("messages", _messages(timed)).where(F.size("messages") > 0)
    title = F.coalesce("title", F.substring(F.get("messages", F.lit(0))["text"], 1, 60))
    return _session(rows.withColumn("title", title).withColumn("started_at", instant(F.col("started_at"))).withColumn("ended_at", instant(F.col("ended_at"))), user)


def read_jsonl(spark: SparkSession, path: str, user: str = "local") -> DataFrame:
    return parse_jsonl(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path), user)


def parse_logs(files: DataFrame, source: str = "cli", markers: tuple[str, ...] = SESSION_MARKERS, user: str = "local") -> DataFrame:
    """Event logs, one file a session, in ``files(path, value)`` with whole files as values.

    Side chains, other event types and blank texts are dropped; content is a string or a list of text blocks. A session
    whose first user message, without wrappers, holds one of ``markers`` in its head is dropped. Started and ended are the first and last
    message's times; the title is the first message that isn't empty without its wrappers.
    """
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    rows = lines.select("path", "pos", F.from_json("line", LOG_LINE).alias("r")).select("path", "pos", "r.*")
    rows = rows.where("type in ('user', 'assistant') and not coalesce(isSidechain, false) and message is not null")
    blocks = F.from_json(F.col("message.content"), BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    text = F.when(F.col("message.content").rlike(r"^\s*\[\s*\{"), joined).otherwise(F.col("message.content"))
    rows = rows.select("path", "pos", F.coalesce("message.role", "type").alias("role"), text.alias("text"), instant(F.col("timestamp")).alias("ts")).where(F.length(strip(F.col("text"))) > 0)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "role", "text", "ts")))
    g = rows.groupBy("path").agg(ordered.alias("m")).withColumn("messages", _messages(F.col("m"))).where(F.size("messages") > 0)
    first_user = F.get(F.filter("messages", lambda x: x["role"] == "user"), F.lit(0))["text"]
    if markers:
        g = g.where(first_user.isNull() | ~is_meta(first_user, markers))
    shown = F.filter(F.transform("messages", lambda x: strip_wrappers(x["text"])), lambda t: F.length(t) > 0)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return _session(
        g.select(
            F.lit(source).alias("source"), stem.alias("native_id"), F.coalesce(F.substring(F.get(shown, F.lit(0)), 1, 60), stem).alias("title"),
            F.get("messages", F.lit(0))["ts"].alias("started_at"), F.element_at("messages", -1)["ts"].alias("ended_at"), "messages",
        ), user,
    )


def read_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    return parse_logs(files.select(F.col("_metadata.file_path").alias("path"), "value"), **options)


def canonical_branch(mapping: Column, current: Column) -> Column:
    """Node ids from the root to ``current``: a walk up the parents, at most as long as the mapping, stopped by a cycle."""
    step = F.sequence(F.lit(1), F.greatest(F.size(mapping), F.lit(1)))

    def up(path: Column, _: Column) -> Column:
        parent = F.element_at(mapping, F.element_at(path, 1))["parent"]
        more = parent.isNotNull() & F.map_contains_key(mapping, F.coalesce(parent, F.lit(""))) & ~F.array_contains(path, F.coalesce(parent, F.lit("")))
        return F.when(more, F.concat(F.array(parent), path)).otherwise(path)

    start = F.when(F.map_contains_key(mapping, F.coalesce(current, F.lit(""))), F.array(current)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(start) > 0, F.aggregate(step, start, up)).otherwise(start)


def parse_export(files: DataFrame, source: str = "chat-export", user: str = "local") -> DataFrame:
    """Conversation exports in ``files(value)``: a JSON array of message trees, of which the current branch is kept."""
    c = files.select(F.explode(F.from_json("value", EXPORT)).alias("c")).select("c.*").where("mapping is not null")
    c = c.withColumn("branch", canonical_branch(F.col("mapping"), F.col("current_node")))

    def message(node: Column) -> Column:
        m = F.element_at(F.col("mapping"), node)["message"]
        text = strip(F.array_join(F.filter(m["content"]["parts"], lambda p: p.isNotNull()), "\n"))
        ok = m["content"]["content_type"] == "text"
        return F.struct(F.when(ok, m["author"]["role"]).alias("role"), text.alias("text"), epoch(m["create_time"]).alias("ts"))

    c = c.withColumn("messages", _messages(F.transform("branch", message))).where(F.size("messages") > 0)
    times = F.transform("messages", lambda x: x["ts"])
    native = F.coalesce("id", "conversation_id")
    return _session(c.where(native.isNotNull()).select(F.lit(source).alias("source"), native.alias("native_id"), "title", F.coalesce(epoch(F.col("create_time")), F.array_min(times)).alias("started_at"), F.array_max(times).alias("ended_at"), "messages"), user)


def read_export(spark: SparkSession, path: str, **options) -> DataFrame:
    """A JSON file, a folder of them, or ZIP files that hold ``conversations.json``."""
    plain = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)

    def unzip(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        texts = [z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.endswith("conversations.json")]
                except zipfile.BadZipFile:
                    texts = []
                yield pa.record_batch([pa.array(texts, pa.string())], ["value"])

    zipped = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    return parse_export(plain.union(zipped.select("content").mapInArrow(unzip, "value string")), **options)
