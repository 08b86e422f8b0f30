from __future__ import annotations

import re
import zlib

import numpy as np

import corpus_pipeline
from tests.conftest import DATA as SMALL
from threadlode.llm import mixing, pii, quality, simhash
from threadlode.llm.packing import CAPACITY
from threadlode.llm.tokens import Chunker, vocabulary_path

DATA = SMALL.replace("0.001", "0.01")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, at, seen = docs.columns, docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, DATA)
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen.append(at)
        assert k == len(corpus_pipeline.STAGES) - 1 or at.columns == columns
    texts = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in (docs, *seen[:4])]
    keep = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect() if r["keep"]}
    assert {*texts[1]} == keep and 0 < len(keep) < len(texts[0])
    # one document of each group stays: brute force on fingerprints
    ids = sorted(keep)
    fps = np.array([simhash.fingerprint(texts[1][d]) for d in ids], np.uint64)
    near, label = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, np.arange(len(ids))
    for _ in ids:
        label = np.array([label[n].min() for n in near])
    assert {*texts[2]} == {ids[k] for k in {*label.tolist()}}
    assert {*texts[3]} == {*texts[2]} == {*texts[4]}
    for d, text in texts[3].items():
        assert not any(kind in ("email", "ip") for *_, kind in pii.base_spans(text))
        if not pii.base_spans(texts[2][d]) and not pii._TRIGGER.search(texts[2][d]):
            assert text == texts[2][d]
    assert texts[4] == texts[3]
    coder = Chunker(vocabulary_path("byte_bpe_50k.json"), True)
    pieces: dict = {}
    for r in seen[4].collect():
        assert r["offset"] + r["length"] <= CAPACITY
        pieces.setdefault(r["doc_id"], []).append(r)
    assert {*pieces} == {*texts[4]}
    for d, parts in pieces.items():
        raw, start = np.array([*coder.whole(texts[4][d]), 0], "<u4").tobytes(), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == start and r["ids_crc32"] == zlib.crc32(raw[4 * start : 4 * (start + r["length"])])
            start += r["length"]
        assert 4 * start == len(raw)
    # the mix decides the order of sequences: each is numbered by its first piece in the mix
    place = {d: k for k, d in enumerate(r["doc_id"] for r in seen[3].select("doc_id").collect())}
    first: dict = {}
    for r in (r for parts in pieces.values() for r in parts):
        first[r["sequence_id"]] = min((place[r["doc_id"]], r["start"]), first.get(r["sequence_id"], (1 << 60, 0)))
    opened = [first[k] for k in range(len(first))]
    assert opened == sorted(opened) and len(opened) > 50


def test_registered():
    import __spark_entry__ as entry

    names = {*entry.queries()}
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {*entry.oracle_sql()} <= names


def _odd(spark, *more):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "x" * 50_000, "en", None, 50_000), (2, "x" * 50_000, "en", None, 50_000), (3, "mail me at a@b.example.com please, it is me who asks", "en", "a", 52)]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"{m} string" for m in more]]
    return spark.createDataFrame([(*r, *[f"{m}{k}" for m in more]) for k, r in enumerate(rows)], ", ".join(names))


def test_odd_documents(spark):
    for table in (_odd(spark), _odd(spark).limit(0)):
        at, seen = table, []
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, DATA)
            seen.append(at.collect())
        if not table.count():
            assert seen == [[]] * 5
            continue
        texts = [[(r["doc_id"], r["text"]) for r in s] for s in seen[:4]]
        assert {*texts[0]} <= {(r["doc_id"], r["text"]) for r in table.collect()}
        # null and empty texts have the same fingerprint, and so have the two long ones
        groups = {("" if not t else t) for _, t in texts[0]}
        assert len(texts[1]) == len(groups) and {*texts[1]} <= {*texts[0]}
        assert not any("@b.example" in (t or "") for _, t in texts[2]) and [d for d, _ in texts[2]] == [d for d, _ in texts[1]]
        assert sorted(map(str, texts[3])) == sorted(map(str, texts[2]))
        assert sorted({str(r["doc_id"]) for r in seen[4]}) == sorted({str(d) for d, _ in texts[3]})


def test_clashing_columns(spark):
    """Columns by names that stages use themselves come back unchanged."""
    more = ["_row", "_D", "_s", "_position", "number", "fp", "group", "component_id", "features", "row", "slot", "_n", "_part", "file", "at", "run"]
    docs = _odd(spark, *more)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        kept = {tuple(r[m] for m in more) for r in out.collect()}
        assert kept and kept <= {tuple(f"{m}{k}" for m in more) for k in range(5)}, name
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, docs, DATA).collect()} == {1, 2, 3, None}


def test_plans_do_not_change_with_size(spark, capsys):
    """Stages that join texts with a row per document shuffle them on small tables too: what they take grows with the input."""
    docs = spark.createDataFrame([(k, f"text number {k}", "s") for k in range(20)], "doc_id long, text string, source string")
    for stage in (simhash.one_of_each, mixing.mixed_documents):
        capsys.readouterr()
        out = stage(docs)
        out.explain()
        last = re.search(r"\w+Join\b", capsys.readouterr().out).group()  # a plan is shown from its end
        assert last == "SortMergeJoin"
        assert out.count() == 20
