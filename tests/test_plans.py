from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from threadlode.catalog import QUERIES
from threadlode.oracles import ORACLES
from threadlode.plans import lenses, review

#: Plans that between them use every operator; the driver compares all queries.
SOME = ("upsert_classify", "pending_distill", "render_prompt", "links_topk", "recall", "recall_handoff", "digest_items", "proposal_candidates", "overview", "timeline_weeks", "commit_xref", "export_sessions", "kv_spellings", "label_cache", "status_cache", "digest_outcomes", "doctor_checks", "embed_missing", "recall_commits", "digests_data", "theme_content_hash", "theme_rollup", "refresh_links", "refresh_themes", "stream_ingest")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


@pytest.fixture(scope="module")
def many_commits(tmp_path_factory):
    """The small tables with 460 commits: the first 300 repeat the benchmark's texts, the others are documents."""
    folder = tmp_path_factory.mktemp("many_commits")
    for path in glob.glob(f"{DATA}/*.parquet"):
        if not path.endswith("/benchmark.parquet"):
            os.symlink(path, folder / os.path.basename(path))
    text = f"""select r as item_id, b.text from range(300) t(r) join '{DATA}/benchmark.parquet' b on b.item_id = r % 40
      union all select 300 + doc_id, text from '{DATA}/documents.parquet' where doc_id < 160"""
    duckdb.sql(f"copy ({text}) to '{folder}/benchmark.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["recall_commits", "recall_handoff", "commit_xref"])
def test_more_commits_than_the_newest(spark, many_commits, name):
    """``recall_commits`` reads all, the other two the newest 300 as their SQL does."""
    con = duckdb.connect()
    for path in glob.glob(f"{many_commits}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = QUERIES[name](spark, many_commits)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert want and sorted(map(repr, want)) == sorted(map(repr, rows))
    if name == "recall_commits":
        shas = [int(r[3].split()[3][1:]) for r in rows if r[3]]
        assert shas and max(shas) >= 300


def test_commits_of_equal_or_no_position(spark):
    hits = spark.createDataFrame([("a", "one two", "three four five six", "w", "open"), ("b", "ten", "eleven twelve", "w", "open"), ("c", "ten one", "two", "w", None)], "ref string, title string, summary string, why string, status string")
    rows = [(None, "s", "one two three"), (7, "t", "three one two"), (900, "u", "one two four"), (900, "v", "six"), (901, "x", "ten eleven twelve"), (5, "y", None)]
    got = lenses.with_commits(hits, spark.createDataFrame(rows, "pos long, sha string, message string")).collect()
    assert sorted((r["ref"], r["git_ref"]) for r in got if r["git_ref"]) == [("a", "possibly implemented in u — “one two four”"), ("a", "possibly implemented in v — “six”"), ("b", "possibly implemented in x — “ten eleven twelve”")]
    assert [r["why"] for r in got if r["ref"] == "c"] == ["w"] and all(r["why"].endswith("addressed this") for r in got if r["ref"] != "c")


def test_every_query_is_registered():
    assert {*ORACLES} <= {*QUERIES} and {*QUERIES} <= {*entry.queries()}
    assert {*QUERIES} - {*ORACLES} == {"cluster_hdbscan", "distill_notes", "generate_proposals"}


def test_degraded_and_rates(spark):
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    run = lambda d, a, s: review.refresh_stats(one("outcome", *d), one("way", *a), one("way", *s)).first()["degraded"]
    assert run(["cold"], [], []) and run(["ok"], ["fallback"], []) and run(["ok"], ["llm"], ["heuristic"])
    assert not run(["ok", "cold"], ["cached", "llm"], ["ok", "na"])
    assert review.outcome_counts(one("outcome", "pending")).first()["hit_rate"] is None
    assert review.outcome_counts(one("outcome", "kept", "dismissed", "dismissed")).first()["hit_rate"] == 33


def test_digest_due(spark):
    log = spark.createDataFrame([(5,)], "ts_us long")
    week = 7 * 86_400_000_000
    assert review.digest_due(log.where("false"), 0).first()["is_due"] and not review.digest_due(log, 5 + week - 1).first()["is_due"] and review.digest_due(log, 5 + week).first()["is_due"]


def test_generated_proposals_against_plain_python(spark):
    """The registered query's provider by plain Python: cites, rejections, novelty and ratings."""
    import hashlib

    from threadlode.operators.embedding import hash_embedder
    from threadlode.plans.bindings import Tables

    t = Tables(spark, DATA)
    raw = {r["conv_id"]: r["text"].strip()[:400] for r in t.messages.where("idx = 1").collect()}
    notes = {r["note_id"]: r for r in t.notes.collect()}
    embed = hash_embedder(8)
    want = {}
    for theme in t.themes.where("session_count >= 2").collect():
        lines, used = [], 0
        for i in theme["note_ids"]:
            n = notes[i]
            line = f"[{i}] ({n['kind']}, {n['source']}) {n['text']}" + (f"\n    raw: {raw[n['vec_id']]}" if raw.get(n["vec_id"]) else "")
            used += len(line)
            if used > 6000:
                break
            lines.append(line)
        prompt = "\n".join(lines)
        ids = [line[1:].split("]")[0] for line in lines]
        if not prompt or len(prompt) % 5 == 2:
            continue
        title, text, step, cites = ("Try", f"fresh {len(prompt)}", "begin", [*dict.fromkeys([ids[0], ids[-1]])])
        reason = None
        if len(prompt) % 5 == 0:
            title, text, step, cites, reason = "No ground", "text", "", [], "no_cites"
        elif len(prompt) % 5 == 1:
            title, text, step, cites, reason = "", "text", "", [], "no_cites"
        key = hashlib.sha256(f"{theme['content_hash']}|{title or reason}".encode()).hexdigest()[:8]
        sim = None if reason else round(max(sum(a * b for a, b in zip(x, y, strict=True)) for x in embed([text]) for y in embed([notes[i]["text"] for i in theme["note_ids"]])), 5)
        if sim is not None and sim > 0.9:
            reason, step, cites, sim = "paraphrase", "", [], None
        rating = None if reason or len(f"{title}\n{text}\nNext step: {step}") % 2 else 4
        want[theme["theme_id"]] = ("prop:" + key, title or "(rejected)", text, step, ",".join(cites), rating, "rejected" if reason else "pending", reason, sim)
    got = {r["source_ref"]: r for r in QUERIES["generate_proposals"](spark, DATA).collect()}
    assert {*got} == {*want} and {w[7] for w in want.values()} >= {None, "no_cites"}
    for ref, w in want.items():
        r = got[ref]
        assert (r["proposal_id"], r["title"], r["text"], r["next_step"], r["cites"], r["feasibility"], r["outcome"], r["reject_reason"]) == w[:8]
        assert (r["novelty_sim"] is None) == (w[8] is None) and (w[8] is None or abs(r["novelty_sim"] - w[8]) < 2e-5)
