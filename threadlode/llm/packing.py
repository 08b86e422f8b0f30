"""Harmonic packing of token ids into sequences of a fixed capacity.

Piece lengths belong to reciprocal classes: class j holds pieces of exactly capacity // j ids, and each of its bins
takes exactly j of them, so where a piece goes depends on its rank in its class alone and workers pack without
talking. Documents may be cut freely, so each is cut from the front into the largest classes that fit: full
sequences first, then a half, a third and so on. Pieces of at most ``SMALL`` ids are classes of their own length.
A full bin of class j leaves capacity - j * (capacity // j) ids of padding, less than j; only each class's last bin
may be partly filled, and those few bins (one a class) are put together in first-fit order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlode.llm.common import map_batches, numbered
from threadlode.llm.tokens import TOKEN_BYTES, vocabulary_path, worker_chunker
from threadlode.session import materialize

CAPACITY = 1024
#: Pieces up to this length are not cut further.
SMALL = 32


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The number of equal pieces of ``length`` that one bin holds."""
    return capacity // length


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Cut ``n`` ids into pieces of reciprocal classes, largest first."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > SMALL:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out + [n] * (n > 0)


PIECES = "part int, run int, file string, at long, nth long, class int, rank long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY, vocabulary_file: str | None = None) -> DataFrame:
    """One row per piece, with its class and its rank among the class's pieces of the same run. A run is what a task reads of one part of one
    file (or all of it, if ``docs`` isn't read from files); its first piece has the file's name and the place of the part in it, and ``nth`` counts its pieces."""
    keep_space = vocabulary.startswith("byte")

    def cut(batches):
        coder = worker_chunker(vocabulary_file or vocabulary_path(vocabulary), keep_space)
        part, seen, cuts = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), {}
        run, last, nth = -1, None, 0
        for batch in (b for whole in batches for b in _by_file(whole)):
            here = (batch.column("file")[0].as_py(), batch.column("at")[0].as_py())
            opens = here != last
            if opens:
                run, last, nth = run + 1, here, 0
                seen[:] = 0
            flat, sizes = coder.batch(batch.column("text"))
            own = memoryview(np.insert(flat, np.cumsum(sizes), end_id).astype("<u4").tobytes())
            tokens = sizes + 1
            for n in set(tokens.tolist()).difference(cuts):
                cuts[n] = np.array(piece_lengths(n, capacity), np.int64)
            parts = [cuts[n] for n in tokens.tolist()]
            length = np.concatenate([np.zeros(0, np.int64), *parts])
            of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            ends = np.cumsum(length)
            start = ends - length - (np.cumsum(tokens) - tokens)[of]
            # ranks go on from those of the run's earlier batches
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - first + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            crc = [zlib.crc32(own[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            none = [None] * (len(length) - 1)
            marks = [here[0], *none] if opens else [None, *none]
            columns = [np.full(len(length), part), np.full(len(length), run), marks, [here[1], *none] if opens else [None, *none], nth + np.arange(len(length)), length, rank, batch.column("doc_id").take(pa.array(of)), start, length, crc, tokens[of]]
            nth += len(length)
            yield pa.record_batch([pa.array(c, t) if isinstance(c, list) else pa.array(c).cast(t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 6, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    if "file" not in docs.columns:
        docs = docs.select("doc_id", "text", F.lit("").alias("file"), F.lit(0).cast("long").alias("at"))
    return map_batches(docs, cut, PIECES, TOKEN_BYTES)


def _with_files(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, at): where each row was read from. Rows that come from more than one place are written first, in their order."""
    rows, source = docs.select("doc_id", "text"), [F.input_file_name().alias("file"), F.input_file_block_start().alias("at")]
    try:
        return rows.select("*", *source)
    except AnalysisException:
        return materialize(rows, "packing-order").select("*", *source)


def _by_file(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch that come from one part of one file each."""
    if batch.num_rows:
        names, at = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column("at").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(names) != 0) | (np.diff(at) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, in_order: bool = False, **options) -> DataFrame:
    """Pack all ids of ``docs(doc_id, text)``, ``end_id`` after each document; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text counts as empty (its end id
    alone); rows that repeat a doc_id are packed each; a null doc_id stays null. Sequences are numbered without gaps.
    An empty table gives no rows. Other columns are ignored.

    ``in_order``: bins are filled in the order in which ``docs`` was written (by file name, and by row in a file), and sequences are numbered by their
    first piece, so that whoever reads sequences in order reads documents in that order, as far as the bins of a class allow: a bin of class j waits
    for j pieces.
    """
    rows = _with_files(docs) if in_order else docs.select("doc_id", "text")
    cut = materialize(pieces(rows, capacity=capacity, **options), "pieces")
    runs = cut.groupBy("part", "run").agg(F.max("file").alias("file"), F.max("at").alias("at"))
    runs = runs.select("part", "run", F.row_number().over(Window.orderBy("file", "at", "part", "run")).alias("run_no"))  # a row a run
    counts = cut.groupBy("class", "part", "run").agg(F.count("*").alias("n")).join(runs, ["part", "run"])
    before = Window.partitionBy("class").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    bases = counts.select("class", "part", "run", "run_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row a class: under 100
    rows = _bins(totals, capacity)
    bins = spark.createDataFrame(rows, "class int, per_bin long, full long, first long, tail_sequence long, tail_offset long")
    ranked = cut.join(bases, ["class", "part", "run"]).withColumn("place", F.col("base") + F.col("rank")).join(F.broadcast(bins), "class")  # bins: a row a class
    in_full = F.expr("place < full * per_bin")
    placed = ranked.select(
        *(["run_no", "nth"] if in_order else []), "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(in_full, F.expr("first + place div per_bin")).otherwise(F.col("tail_sequence")).alias("sequence_id"),
        F.when(in_full, F.expr("(place % per_bin) * class")).otherwise(F.expr("tail_offset + (place - full * per_bin) * class")).alias("offset"),
    )
    if not in_order:
        return placed
    placed = materialize(placed, "placed-pieces")
    firsts = placed.groupBy("sequence_id").agg(F.min(F.struct("run_no", "nth")).alias("first")).select("sequence_id", "first.run_no", "first.nth")
    order = numbered(firsts, ["run_no", "nth"], [], "sequence-order").select("sequence_id", F.col("number"))
    return placed.join(order, "sequence_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("number").alias("sequence_id"), "offset")


def _bins(totals: dict[int, int], capacity: int) -> list[tuple]:
    """For each class its bin size, full bins and their first number, and where the rest of it goes."""
    first, rows, tails = 0, [], []
    for length, n in sorted(totals.items(), reverse=True):
        per_bin = class_of(length, capacity)
        full, rest = divmod(n, per_bin)
        rows.append([length, per_bin, full, first, 0, 0])
        first += full
        tails.append((rest * length, len(rows) - 1))
    open_bins: list[int] = []
    for used, k in sorted(tails, reverse=True):
        if used:
            place = next((b for b, u in enumerate(open_bins) if u + used <= capacity), len(open_bins))
            if place == len(open_bins):
                open_bins.append(0)
            rows[k][4:] = [first + place, open_bins[place]]
            open_bins[place] += used
    return [tuple(r) for r in rows]
