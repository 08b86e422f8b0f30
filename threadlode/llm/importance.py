"""Importance resampling towards a target distribution, with hashed n-grams and a ring of running checksums.

One scan of a document keeps the running zlib states of the last n word starts: each word extends every state by a space and its bytes, begins
a state of its own, and every state, after every word, is the checksum of one run of words; modulo the number of buckets it is a feature. No run
is ever put together as a string. The scan writes each document's buckets, two bytes each; all that follows reads those.

Counts by bucket are all that the corpus and the target pass on: a row per bucket and task, and one array of gains. Documents are scored against
the gains where their buckets lie, and the draw is a global order by score, without replacement, as the scores hold Gumbel noise: ranges are
sorted each in a task and only their counts meet.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.llm.common import map_batches, numbered, word_runs
from threadlode.session import materialize

BUCKETS = 10_000
LONGEST = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25


def ring(runs: Iterator[list[bytes]], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, array]:
    """The number of words, and the bucket of every run of 1 to ``longest`` consecutive words, by where runs end, the shortest first."""
    crc, older, out, n = zlib.crc32, longest - 1, array("H"), 0
    live: list[int] = []  # states of the last starts, the youngest first
    for words in runs:
        n += len(words)
        for word in words:
            state = crc(word)
            if live:
                more = b" " + word
                live = [state, *[crc(more, s) for s in live[:older]]]
            else:
                live = [state]
            out.extend([s % buckets for s in live])
    return n, out


def scan(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row of ``docs(doc_id, text)``; buckets are unsigned 16-bit numbers, end to end."""
    if not 0 < buckets <= 1 << 16 or longest < 1:
        raise ValueError("buckets must be 1 to 65536, and the longest run at least one word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ring(word_runs(t), longest, buckets) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_buffer(), np.uint16), minlength=buckets)
        yield pa.record_batch([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    rows = map_batches(scanned.select("buckets"), run, "bucket long, n long").where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier each bucket is in the target), one added to every count."""
    total_s, total_t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (total_s + n) / ((s + 1) * (total_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(1000 times a Gumbel variate) that depends on the document's id alone; a null id is hashed as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_features, weight, score, rank; ``target(text)`` holds the texts to come near to.

    Drawn are the floor(percent * N / 100) highest scores of the N documents with at least ``least_words`` words, ties to the smaller doc_id (null
    last, then by fewer features and less weight); ``rank`` is their place from 1, and null for all others. A null or empty text has no words, no features and
    the weight 0. Rows that repeat a doc_id are scored each, with the same noise. An empty target leaves the counts of ``docs`` alone to decide; an
    empty table gives no rows. Other columns are ignored. Texts of any length are scanned a megabyte at a time.
    """
    scanned = materialize(scan(docs, longest, buckets), "resample-buckets")
    wanted = materialize(scan(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets), "target-buckets")
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(wanted, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(b.as_buffer(), np.uint16)].sum()) for b in batch.column("buckets")]
            weight = [s // n if n else 0 for s, n in zip(sums, batch.column("n_features").to_pylist(), strict=True)]
            score = [w + noise(d, seed) for w, d in zip(weight, batch.column("doc_id").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    scored = materialize(map_batches(scanned, run, "doc_id long, n_words long, n_features long, weight long, score long"), "resample-scores")
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count() * percent // 100
    keyed = able.select("doc_id", "n_features", "weight", "score", F.col("doc_id").isNull().alias("nameless"), (-F.col("score")).alias("down"), F.monotonically_increasing_id().alias("row"))
    placed = numbered(keyed, ["down", "nameless", "doc_id", "n_features", "weight", "row"], [], "resample-order")
    rank = F.when(F.col("number") < n, F.col("number") + 1).alias("rank")
    rest = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank).union(rest)
