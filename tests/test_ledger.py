from __future__ import annotations

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadlode.operators import caches, distill, ledger
from threadlode.plans import proposals
from threadlode.providers import Unavailable


@pytest.fixture
def calls(tmp_path):
    """A provider's log: each call leaves a file, wherever it was made."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def note(prompt: str) -> None:
        (folder / f"{uuid.uuid4().hex}").write_text(prompt)

    return note, lambda: sorted(p.read_text() for p in folder.iterdir())


def _prompts(spark, n, copies=1):
    return spark.createDataFrame([(f"k{k:02d}-{c}", f"prompt {k}") for k in range(n) for c in range(copies)], "key string, prompt string")


def test_repeats_are_asked_once_and_only_pending_again(spark, calls, tmp_path):
    note, made = calls
    folder = str(tmp_path / "ledger")

    def provider(prompt):
        note(prompt)
        if prompt.endswith("3") and len(made()) < 100:
            raise Unavailable(0.0)
        return [prompt, random.random()]

    first = ledger.replies(_prompts(spark, 6, 3), "key", provider, folder)
    assert made() == [f"prompt {k}" for k in range(6)]
    one = {(r["key"], r["how"], r["reply"]) for r in first.collect()}
    assert one == {(r["key"], r["how"], r["reply"]) for r in first.collect()} and len(one) == 18
    assert {k[:3] for k, how, _ in one if how == "cold"} == {"k03"} and len({r for _, _, r in one}) == 6
    again = {(r["key"], r["how"], r["reply"]) for r in ledger.replies(_prompts(spark, 8), "key", provider, folder).collect()}
    assert made() == sorted([*[f"prompt {k}" for k in range(6)], "prompt 3", "prompt 6", "prompt 7"])
    assert {x for x in one if x[1] == "ok" and x[0].endswith("-0")} <= again
    assert {r["attempt"] for r in spark.read.parquet(folder).where("how = 'cold'").collect()} == {1, 2}


def test_roles_nulls_and_empty_tables(spark, calls, tmp_path):
    note, made = calls
    rows = spark.createDataFrame([(None, "a"), ("x", None), ("y", "")], "key string, prompt string")
    for role in ("one", "two"):
        got = ledger.replies(rows, "key", lambda p: note(p) or [p], str(tmp_path / "l"), role)
        assert sorted((str(r["key"]), r["reply"]) for r in got.collect()) == [("None", '["a"]'), ("x", '[""]'), ("y", '[""]')]
    assert made() == ["", "", "a", "a"]
    assert ledger.replies(rows.limit(0), "key", lambda p: [p]).count() == 0


def test_a_broken_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "ledger")

    def dies(prompt):
        raise SystemExit  # the worker goes, and the job with it

    with pytest.raises(Exception):  # noqa: B017
        ledger.replies(_prompts(spark, 3), "key", dies, folder).collect()
    assert not [*Path(folder).glob("*.parquet")]
    assert {r["how"] for r in ledger.replies(_prompts(spark, 3), "key", lambda p: [p], folder).collect()} == {"ok"}


def test_proposals_with_a_provider_that_never_repeats_itself(spark, calls, tmp_path):
    note, made = calls
    grounds = spark.createDataFrame([(f"t{k}", "theme", f"h{k}", [f"note:{k:016x}"], f"ground {k}") for k in range(10)], "source_ref string, kind string, source_hash string, note_ids array<string>, prompt string")
    vectors = grounds.select(F.col("note_ids")[0].alias("note_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))

    def generate(prompt):
        note(prompt)
        k = int(prompt.split()[1])
        return f"title {random.random()}", ("same" if k % 2 else "new") + f" {random.random()}", "next", f"note:{k:016x}"

    embed = lambda c: F.when(c.startswith("same"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    critic = lambda prompt: note("critic") or ("3", "risk")
    run = lambda: proposals.generated(grounds, vectors, generate, critic, embed, "m", str(tmp_path / "ledger"))
    made_rows = run()
    rows = made_rows.collect()
    assert len(made()) == 15 and rows == made_rows.collect() and len(made()) == 15
    assert {(r["source_ref"], r["outcome"], r["reject_reason"]) for r in rows} == {(f"t{k}", "rejected" if k % 2 else "pending", "paraphrase" if k % 2 else None) for k in range(10)}
    assert {(r["outcome"], r["novelty_sim"] is None, r["feasibility"]) for r in rows} == {("pending", False, 3), ("rejected", True, None)}
    assert sorted(map(str, run().collect())) == sorted(map(str, rows)) and len(made()) == 15


def test_notes_and_checkpoint_come_from_one_call(spark, calls, tmp_path):
    note, made = calls
    prompts = _prompts(spark, 10).withColumnRenamed("key", "session_id")
    rows = distill.distill(prompts, lambda p: note(p) or [("idea", f"note {random.random()}", "msg:0")], str(tmp_path / "l"))
    sessions = prompts.select("session_id", F.lit("h").alias("content_hash"))
    assert distill.notes_of(rows).count() == 10 and distill.checkpoint(rows, sessions, 1).count() == 10
    assert distill.notes_of(rows).exceptAll(distill.notes_of(rows)).count() == 0 and len(made()) == 10


def test_labels_are_asked_once(spark, calls, tmp_path):
    note, made = calls
    themes = spark.createDataFrame([(f"t{k}", f"h{k}", "own") for k in range(4)], "theme_id string, content_hash string, label string")
    notes = spark.createDataFrame([(f"t{k}", f"n{k}", f"text {k}") for k in range(4)], "theme_id string, note_id string, text string")
    none = spark.createDataFrame([], "content_hash string, label string, summary string")
    got = caches.labels(themes, notes, none, lambda p: note(p) or (f"label {random.random()}", ""), str(tmp_path / "l"))
    kept = got.where("way = 'llm'").select("content_hash", "label", "summary")  # what a caller appends to the cache
    assert {(r["content_hash"], r["label"]) for r in kept.collect()} == {(r["content_hash"], r["label"]) for r in got.collect()} and len(made()) == 4
