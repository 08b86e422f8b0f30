from __future__ import annotations

import zlib

import numpy as np

from tests.conftest import DATA
from threadlode.llm import packing
from threadlode.llm.tokens import Chunker, vocabulary_path


def _check(rows, got):
    coder = Chunker(vocabulary_path("byte_bpe_50k.json"), True)
    want = sorted((d, np.array([*coder.whole(t or ""), 0], "<u4").tobytes()) for d, t in rows if d is not None)
    lengths = {d: len(x) // 4 for d, x in want}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    if len({d for d, _ in want}) == len(want):
        for d, raw in want:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == lengths[d] and r["length"] > 0
                assert r["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + r["length"])])
                at += r["length"]
            assert at == lengths[d]
    used = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        used += at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return used / (len(by_sequence) * packing.CAPACITY)


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _check(rows, packing.pack(spark, docs.repartition(5)).collect()) > 0.97


def test_in_order(spark, tmp_path):
    """Sequences follow the order in which the files were written, whatever their sizes."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = packing.pack(spark, spark.read.parquet(str(tmp_path / "d")), in_order=True).collect()
    assert _check(rows, got) > 0.97
    first = {}
    for r in got:
        first[r["sequence_id"]] = min((r["doc_id"], r["start"]), first.get(r["sequence_id"], (1 << 60, 0)))
    opened = [first[k] for k in range(len(first))]
    assert opened == sorted(opened) and len(opened) > 50


def test_odd_rows_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "word " * 20000), (4, "  two  spaces\n\n\nend "), (None, "no id"), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, length int")
    got = packing.pack(spark, df).collect()
    _check(rows, got)
    assert any(r["doc_id"] is None for r in got)
    twice = packing.pack(spark, df.union(df)).collect()
    assert len(twice) == 2 * len(got)
    _check(rows + rows, twice)
    assert packing.pack(spark, df.limit(0)).count() == 0


def test_classes_fill_with_little_padding():
    for n in range(1, 5000):
        parts = packing.piece_lengths(n)
        assert sum(parts) == n and min(parts) > 0
        for x in parts:
            count = packing.class_of(x)
            assert count * x <= 1024 and (x <= packing.SMALL or 1024 // count == x)
    assert packing._bins({}, 1024) == []
