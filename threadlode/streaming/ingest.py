"""Incremental ingest: a file stream of normalised sessions, upserted by key.

Changed sessions replace their earlier version, so there's no window to close and no watermark. The stream's checkpoint
is the marker of what was read, and the table knows the last batch that it took from a stream, so a replay does nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlode import schemas
from threadlode.operators.store import latest, upsert
from threadlode.session import materialize
from threadlode.sources.transcripts import parse_jsonl

#: Hashed buckets of a table, the files of one, and the places that a bucket and the manifest have in turn.
BUCKETS, FILES, SLOTS = 64, 4, 3
MANIFEST = "version long, buckets int, slots map<int, int>, batches map<string, long>"


class Manifest(NamedTuple):
    """A committed state: which slot holds each bucket, and the last batch taken from each stream."""

    version: int = 0
    slots: dict[int, int] = {}
    batches: dict[str, int] = {}


class SessionTable:
    """A sessions table in hashed buckets, each in one of ``SLOTS`` places: ``data/bucket=b/slot=s``.

    A commit writes every bucket that it touches as a whole, ``FILES`` files at most, into the bucket's next slot, over
    what it held ``SLOTS`` changes ago, and then one manifest file into the manifest's next slot. The state is that of the
    manifest with the highest version, so a commit that dies before its manifest leaves the last state, and its remains
    are overwritten by the next. Files never exceed ``buckets * FILES * SLOTS``: old versions need no vacuum, small files no
    compaction. Read a ``current()`` before a bucket has changed ``SLOTS`` - 1 times more. One writer at a time; the renaming
    of one file has to be atomic in the file system.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def manifest(self) -> Manifest:
        """The last committed state; raises where the table was written with another number of buckets."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()  # a row for each slot
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if not rows:
            return Manifest()
        last = max(rows, key=lambda r: r["version"])
        if last["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {last['buckets']} buckets, not {self.buckets}")
        return Manifest(last["version"], last["slots"], last["batches"])

    def _commit(self, m: Manifest) -> None:
        row = self.spark.createDataFrame([(m.version, self.buckets, m.slots, m.batches, m.version % SLOTS)], f"{MANIFEST}, slot int")
        row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(f"{self.path}/manifest")

    def _read(self, slots: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/bucket={b}/slot={s}" for b, s in sorted(slots.items())]
        return self.spark.read.schema(schemas.SESSION).parquet(*paths) if paths else self.spark.createDataFrame([], schemas.SESSION)

    def current(self) -> DataFrame:
        return self._read(self.manifest().slots)

    def apply(self, incoming: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """Merge. Of several versions of a session in one batch the last to start counts. A ``batch`` of ``stream`` that was
        merged before is left out, and False returned; batches of a stream have rising numbers."""
        state = self.manifest()
        if stream is not None and state.batches.get(stream, -1) >= batch:
            return False
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        one = materialize(latest(incoming, ["id"], [F.desc_nulls_last("started_at"), F.desc("content_hash")]), "batch")
        touched = [r["b"] for r in one.select(bucket.alias("b")).distinct().collect()]  # at most as many as there are buckets
        if touched:
            old = self._read({b: state.slots[b] for b in touched if b in state.slots})
            into = {b: (state.slots.get(b, -1) + 1) % SLOTS for b in touched}
            slot = F.element_at(F.create_map(*[F.lit(x) for kv in into.items() for x in kv]), F.col("bucket"))
            rows = upsert(old, one, "id").withColumn("bucket", bucket).withColumn("slot", slot)
            share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FILES))  # of a bucket: one file each
            rows.repartition("bucket", share).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(f"{self.path}/data")
            state = state._replace(slots=state.slots | into)
        self._commit(Manifest(state.version + 1, state.slots, state.batches | ({stream: batch} if stream is not None else {})))
        return True


def ingest_stream(spark: SparkSession, source: str, table: SessionTable, checkpoint: str):
    """Start the stream over ``source`` with all files that are there now; returns the query.

    The table knows the stream by its query's id, which lives as long as the checkpoint does."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).text(source)

    def take(df: DataFrame, batch: int) -> None:
        table.apply(df, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), batch)

    return parse_jsonl(lines).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
