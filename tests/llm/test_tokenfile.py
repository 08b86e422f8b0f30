from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from threadlode.llm import tokenfile
from threadlode.llm.tokens import Chunker, vocabulary_path
from threadlode.session import work_path

ROWS = [(7, "The cat's mat.", "x"), (3, None, "x"), (5, "", None), (9, "long " * 4000, "y"), (3, "again", "y"), (None, "no id", "z"), (3, "again", "y")]


def _expected(spark, rows):
    coder = Chunker(vocabulary_path("word_bpe_49k.json"), False)
    hashed = {r["text"]: r["h"] for r in spark.createDataFrame([(r[1],) for r in rows], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]])):
        ids = np.array([*coder.whole(text or ""), 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)
    got = [tuple(r) for r in tokenfile.token_ids(spark, docs, file_tokens=50).collect()]
    assert sorted(got, key=lambda r: r[1]) == _expected(spark, ROWS)


def test_empty_table(spark):
    assert tokenfile.token_ids(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_random_access_without_copies(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"words of document {k} " * 9) for k in range(40)], "doc_id long, text string")
    path = work_path(spark, "files")
    tokenfile.write_token_files(docs.coalesce(1), path, length=16)
    import glob

    files = sorted(glob.glob(f"{path}/part-*"))
    assert files
    n = 0
    for name in files:
        source = pa.memory_map(name)
        low, high = source.read_buffer().address, source.size()
        source.seek(0)
        file = tokenfile.TokenFile(source)
        ids, mask = file.sequence(0)
        assert len(ids) == len(mask) == 16 and ids.dtype == np.uint16
        for view in (ids, mask):  # both lie in the mapped file
            assert not view.flags.owndata and low <= view.ctypes.data < low + high
        joined = np.concatenate([file.sequence(k)[0][file.sequence(k)[1] > 0] for k in range(len(file))])
        assert (joined == np.concatenate([x for _, x in file.documents()])).all()
        n += len(file.doc_ids)
    assert n == 40


def test_payload_bytes_that_are_no_text(spark):
    """Ids 0 to 65535 hold every pair of bytes, UTF-8 or not: the writer must put them out unchanged."""
    from pyspark.sql import functions as F

    ids = np.arange(1 << 16, dtype=np.uint16)
    payload = tokenfile.stream_bytes(ids, [len(ids)], [5], 0, 0, 1024)
    path = work_path(spark, "bytes")
    spark.createDataFrame([(bytearray(payload),)], "payload binary").select(F.col("payload").cast("string")).write.text(path)
    back = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    assert back == payload + b"\n"
    ((doc_id, found),) = tokenfile.TokenFile(pa.py_buffer(back)).documents()
    assert doc_id == 5 and (found == ids).all()


def test_one_doc_id_for_all_rows_is_dealt_over_tasks(spark):
    docs = spark.createDataFrame([(1, f"text {k % 50}") for k in range(2000)], "doc_id long, text string").repartition(4)
    path = work_path(spark, "files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        tokenfile.write_token_files(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.format("binaryFile").load(path).count() > 1
    rows = tokenfile.read_token_files(spark, path).collect()
    assert len(rows) == 2000 and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
