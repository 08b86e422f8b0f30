"""Token-ID output: Arrow stream files whose batches hold equal-length sequences and masks.

Format of a file: one Arrow IPC stream of record batches with the columns

* ``input_ids``: fixed_size_list<uint16 or uint32>[length], padded with 0,
* ``attention_mask``: fixed_size_list<uint8>[length], 1 where there is a token, dictionary-encoded: a file's masks are two,
  that of a full sequence and that of its last one, and each row points to one of them.

All batches but the last hold ``rows_per_batch`` sequences, so sequence i is row i % rows_per_batch of batch
i // rows_per_batch, and its ids and mask are slices of the mapped file: no copy. The schema's metadata hold the file's
place in the order of all files, its documents' ids and how many tokens each has. A document lies in one file and may span sequences; only a file's
last sequence has padding. A line end follows the stream's end mark; readers stop at that mark.

Files are written by Spark's own text writer (one row, one file), hence through its commit protocol and to any store
that Spark reaches: a task that is lost is run again, and half-written files never count.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlode.llm.common import map_batches
from threadlode.llm.tokens import TOKEN_BYTES, vocabulary_path, worker_chunker
from threadlode.session import materialize, work_path

#: Ids in a file, from which on the next document begins another.
FILE_TOKENS = 2_000_000
ROWS_PER_BATCH = 256


def stream_bytes(ids: np.ndarray, counts: list[int], doc_ids: list, part: int, chunk: int, length: int, rows: int = ROWS_PER_BATCH) -> bytes:
    """One file: ``ids`` of the documents end to end, ``counts`` ids each."""
    n = max(1, -(-len(ids) // length))
    padded = np.zeros(n * length, ids.dtype)
    padded[: len(ids)] = ids
    masks = np.ones(2 * length, np.uint8)
    masks[length + len(ids) - (n - 1) * length :] = 0
    which = pa.array(np.arange(n) == n - 1).cast(pa.int8())
    mask = pa.DictionaryArray.from_arrays(which, pa.FixedSizeListArray.from_arrays(pa.array(masks), length))
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(padded), length), mask]
    meta = {"part": str(part), "chunk": str(chunk), "tokens": str(len(ids)), "rows_per_batch": str(rows), "doc_ids": json.dumps(doc_ids), "doc_tokens": json.dumps(counts)}
    schema = pa.schema([(k, c.type) for k, c in zip(("input_ids", "attention_mask"), columns, strict=True)], metadata=meta)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as sink:
        sink.write_table(pa.table(columns, schema=schema), max_chunksize=rows)
    return out.getvalue().to_pybytes()


class TokenFile:
    """Random access to one file's sequences without copying ids or masks: ``TokenFile(pa.memory_map(path))`` or bytes."""

    def __init__(self, source):
        reader = pa.ipc.open_stream(source)
        self.meta = {k.decode(): v.decode() for k, v in reader.schema.metadata.items()}
        self.batches = list(reader)
        self.rows = int(self.meta["rows_per_batch"])
        self.doc_ids, self.doc_tokens = json.loads(self.meta["doc_ids"]), json.loads(self.meta["doc_tokens"])

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``, both views of the file."""
        batch, row = self.batches[i // self.rows], i % self.rows
        masks = batch.column(1)
        ids, mask = batch.column(0)[row].values, masks.dictionary[masks.indices[row].as_py()].values
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=True)

    def documents(self):
        """(doc_id, ids) in the file's order."""
        ids = np.concatenate([b.column(0).flatten().to_numpy() for b in self.batches])
        held = len(ids) - int((self.sequence(len(self) - 1)[1] == 0).sum())  # only the last sequence has padding
        yield from zip(self.doc_ids, np.split(ids[:held], np.cumsum(self.doc_tokens)[:-1]), strict=True) if self.doc_ids else ()


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, length: int = 1024, vocabulary_file: str | None = None, file_tokens: int = FILE_TOKENS) -> None:
    """Write the ids of all texts of ``docs(doc_id, text)`` in ascending doc_id order, ``end_id`` after each document.

    A null text counts as empty (its end id alone); null doc_ids come first; rows with equal doc_ids are ordered by
    their text's hash and all kept, and may be dealt over many tasks, as may wholly equal rows. Other columns are
    ignored. An empty table gives no file.
    """
    keep_space = vocabulary.startswith("byte")

    def encode(batches):
        coder = worker_chunker(vocabulary_file or vocabulary_path(vocabulary), keep_space)
        kind = np.uint16 if coder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        part, chunk = TaskContext.get().partitionId(), 0
        held, counts, doc_ids, n = [], [], [], 0
        for batch in batches:
            flat, sizes = coder.batch(batch.column("text"))
            edges = np.cumsum(sizes)
            own = np.insert(flat, edges, end_id).astype(kind)
            edges, at = edges + np.arange(1, len(sizes) + 1), 0
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                held.append(own[at : edges[k]])
                at = edges[k]
                counts.append(int(sizes[k]) + 1)
                doc_ids.append(doc_id)
                n += counts[-1]
                if n >= file_tokens:
                    yield pa.record_batch([[stream_bytes(np.concatenate(held), counts, doc_ids, part, chunk, length)]], ["payload"])
                    held, counts, doc_ids, n, chunk = [], [], [], 0, chunk + 1
        if held:
            yield pa.record_batch([[stream_bytes(np.concatenate(held), counts, doc_ids, part, chunk, length)]], ["payload"])

    order = ["doc_id", "hashed", "row"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hashed"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = map_batches(ordered, encode, "payload binary", TOKEN_BYTES)
    # the text writer puts a row's bytes out as they are: a string isn't validated (tests read the files back)
    files.select(F.col("payload").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                file = TokenFile(content.as_buffer())
                found = [(d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, x in file.documents()]
                sizes = [n for _, n, _ in found]
                yield pa.record_batch(
                    [pa.array([int(file.meta[k])] * len(found), kind) for k, kind in (("part", pa.int32()), ("chunk", pa.int32()))]
                    + [pa.array([d for d, *_ in found], pa.int64()), pa.array(np.cumsum([0, *sizes])[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array([c for *_, c in found], pa.int64())],
                    ["part", "chunk", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(read, "part int, chunk int, doc_id long, offset long, n_tokens long, ids_crc32 long"), "token-index")
    totals = rows.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = totals.select("part", "chunk", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(starts, ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write the files in the shared folder and return what they hold."""
    path = work_path(spark, "token-files")
    write_token_files(docs, path, **options)
    if docs.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path)
