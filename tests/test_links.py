from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from threadlode.functions.ids import DAY_US, gap_days, link_id
from tests.conftest import DATA
from threadlode.operators import links, themes

SCHEMA = "note_id string, theme_id string, source string, created_us long, vec array<double>"


def _notes(spark, rows):
    return spark.createDataFrame([(i, t, s, None if d is None else int(d * DAY_US), v) for i, t, s, d, v in rows], SCHEMA)


def test_same_theme_never_links_and_noise_links_with_themes_only(spark):
    v = [1.0, 0.01]
    rows = _notes(spark, [("a", "t1", "s", 0, v), ("b", "t1", "s", 0, v), ("c", "t2", "s", 0, v), ("d", None, "s", 0, v), ("e", None, "s", 0, v)])
    got = {(r["from_note"], r["to_note"]) for r in links.links(rows).collect()}
    assert got == {("a", "c"), ("b", "c"), ("a", "d"), ("a", "e"), ("b", "d"), ("b", "e"), ("c", "d"), ("c", "e")}


def test_weight_grows_with_gap_and_crossing_sources(spark):
    v = [0.6, 0.8]
    w = lambda a, b, s="s": links.links(_notes(spark, [("a", "t1", "s", a, v), ("b", "t2", s, b, v)])).first()["weight"]
    assert w(0, 1) < w(0, 30) < w(0, 90) == w(0, 400)
    assert w(0, 1, "x") > w(0, 1)
    assert w(None, 1) == pytest.approx(1.0, abs=1e-3)


def test_exact_bound(spark):
    rows = _notes(spark, [(c, f"t{c}", "s", 0, [1.0, 0.0]) for c in "abcdef"])
    assert links.links(rows, top=3).count() == 3 and links.links(rows, top=None).count() == 15


def test_blocks_do_not_change_the_result(spark):
    rows = _notes(spark, [(f"n{k}", f"t{k % 3}", "s", k, [math.cos(k / 5), math.sin(k / 5)]) for k in range(30)])
    small, whole = (sorted((r["a"], r["b"]) for r in links.similar_pairs(rows, 0.6, b).collect()) for b in (2, 1000))
    assert small == whole and small


def test_blocks_without_rows_on_one_side(spark):
    rows = _notes(spark, [(f"n{k}", f"t{k}", "s", k, [1.0, 0.0]) for k in range(3)])
    assert links.similar_pairs(rows, 0.6, 1).count() == links.heaviest(rows, 0.6, 9, 1).count() == 3
    assert links.heaviest(rows.limit(0), 0.6, 9, rest=rows).count() == 0 and links.heaviest(rows.where("note_id = 'n1'"), 0.6, 9, 1, rest=rows.where("note_id <> 'n1'")).count() == 2


def test_ids_are_symmetric_and_gaps_floor(spark):
    df = spark.createDataFrame([("x", "y", int(1.5 * DAY_US), 0)], "a string, b string, u long, v long")
    r = df.select(link_id(F.col("a"), F.col("b")).alias("p"), link_id(F.col("b"), F.col("a")).alias("q"), gap_days(F.col("u"), F.col("v")).alias("g"), gap_days(F.col("v"), F.col("u")).alias("h")).first()
    assert r["p"] == r["q"] and (r["g"], r["h"]) == (1, 2)


def test_theme_pairs(spark):
    rows = spark.createDataFrame([("l1", "a", "b", "t1", "t2", 0.9), ("l2", "c", "d", "t2", "t1", 1.2), ("l3", "e", "f", None, "t1", 0.5)], "link_id string, from_note string, to_note string, from_theme string, to_theme string, weight double")
    got = {(r["theme_a"], r["theme_b"]): (r["n_links"], r["max_weight"], r["sample_link"]) for r in links.theme_pairs(rows).collect()}
    assert got == {("t1", "t2"): (2, 1.2, "l2"), ("?", "t1"): (1, 0.5, "l3")}


def test_many_equal_weights_at_the_edge_of_a_rounding(spark):
    """Over a hundred pairs whose weight is right between two roundings, and others that win if it is rounded down."""
    turned = lambda c: [c, (1 - c * c) ** 0.5, 0.0]
    rows = [(f"m{k:02d}", "t1", "s", 0, [1.0, 0.0, 0.0]) for k in range(12)] + [(f"n{k:02d}", "t2", "s", 0, turned(0.80005)) for k in range(12)]
    rows += [(f"a{k:02d}", "t3", "s", 0, [0.80001, 0.0, (1 - 0.80001**2) ** 0.5]) for k in range(6)]
    notes = _notes(spark, rows)
    pairs = lambda df: [(r["from_note"], r["to_note"], r["weight"]) for r in df.collect()]
    for top in (5, 20, 100, 180):
        assert pairs(links.links(notes, top=top)) == pairs(links.best(links.links(notes, top=None), top))


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_packs_do_not_change_the_result(spark):
    rows = _notes(spark, [(f"n{k}", f"t{k % 3}", "s", k, [math.cos(k / 5), math.sin(k / 5)]) for k in range(30)])
    small, whole = (sorted((r["a"], r["b"]) for r in links.similar_pairs(rows, 0.6, 3, p).collect()) for p in (4, 1000))
    assert small == whole and small
    best = lambda **o: [tuple(r) for r in links.best(links.weighed(links.heaviest(rows, 0.6, 20, **o), rows), 20).collect()]
    assert best(pack=4) == best()


def test_no_vector_is_shuffled_for_a_pair(spark, capsys):
    """Pairs of packs come from a cross join of written packs: what is shuffled is each note once, before."""
    rows = _notes(spark, [(f"n{k}", f"t{k}", "s", k, [1.0, 0.0]) for k in range(9)])
    for df in (links.similar_pairs(rows, 0.6, 2), links.heaviest(rows, 0.6, 9, 2)):
        assert "hashpartitioning" not in _plan(df, capsys)


def test_notes_without_an_id_or_a_vector_have_no_links(spark):
    rows = _notes(spark, [("a", "t1", "s", 0, [1.0, 0.0]), ("b", "t2", "s", 0, [1.0, 0.0]), (None, "t3", "s", 0, [1.0, 0.0]), ("d", "t4", "s", 0, None)])
    assert [(r["a"], r["b"]) for r in links.similar_pairs(rows, 0.6).collect()] == [("a", "b")]


def test_plans_over_links_make_notes_once(spark, capsys):
    from threadlode.catalog import QUERIES

    for name in ("connections", "recall_bridges", "links_all"):
        assert "documents.parquet" not in _plan(QUERIES[name](spark, DATA), capsys)


def test_texts_of_notes_are_not_shuffled(spark, capsys):
    """What links and themes are made of is joined without texts, in the same way at any size; those of few notes are looked up."""
    from threadlode.plans.bindings import Tables

    t = Tables(spark, DATA)
    capsys.readouterr()
    t.notes.drop("text").explain("formatted")
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert len(shuffled) == 3 and not any("text#" in columns for columns in shuffled)
    few = t.kept.orderBy("note_id").limit(7).select("note_id")
    whole = {r["note_id"]: (r["text"], r["source"], r["session_id"], r["created_us"], r["kind"]) for r in t.notes.join(few, "note_id").collect()}
    told = t.told(few.union(few)).collect()
    assert len(told) == 7 and {r["note_id"]: (r["text"], r["source"], r["session_id"], r["created_us"], r["kind"]) for r in told} == whole
    assert "text" not in t.kept.columns and sorted(r["label"] for r in t.rollup.collect()) == sorted(r["label"] for r in themes.rollup(t.notes.drop("line_hash", "head")).collect())
    hashes = lambda df: {r["theme_id"]: r["content_hash"] for r in df.collect()}
    assert hashes(t.rollup) == hashes(themes.rollup(t.notes.drop("line_hash", "head")))


def test_links_are_counted_where_they_are_found(spark, capsys):
    """The same counts as of all pairs, in packs of any size; and no pair leaves a task."""
    rows = _notes(spark, [(f"n{k:02d}", f"t{k % 3}" if k % 5 else None, "s", k, [math.cos(k / 5), math.sin(k / 5)]) for k in range(30)] + [("far", "t9", "s", 0, [-1.0, 0.0])])
    want = {r["a"]: r["count"] for r in links.similar_pairs(rows, 0.6).groupBy("a").count().collect()}
    for pack in (1, 4, 1000):
        got = links.link_counts(rows, 0.6, 3, pack)
        assert {r["note_id"]: r["n_links"] for r in got.collect()} == want and got.count() == len(want) > 20
    assert links.link_counts(rows.limit(0)).count() == 0
    from threadlode.catalog import QUERIES

    shown = QUERIES["links_all"](spark, DATA)
    assert "a#" not in (plan := _plan(shown, capsys)) and "sim#" not in plan


#: Queries over stored notes and links.
LINKED = (
    "recall_handoff", "link_reasons", "doctor_repair", "doctor_checks", "rebuild_derived", "overview", "now_view", "bridges", "digest_connections", "digest_items", "proposal_candidates", "demo_seed", "connections", "connections_of_theme", "links_data",
)


@pytest.mark.parametrize("name", LINKED)
def test_no_step_shuffles_the_texts_of_all_notes(spark, capsys, monkeypatch, name):
    """Of what a query writes on its way and of its own plan: notes are made once, in one step, and where documents are read no text is shuffled."""
    from threadlode import catalog, session
    from threadlode.plans import bindings, lenses

    steps = []

    def plan(df):
        capsys.readouterr()
        df.explain("formatted")
        return capsys.readouterr().out

    def written(df, step, *partition_by):
        steps.append((step, plan(df)))
        return session.materialize(df, step, *partition_by)

    for module in (bindings, lenses, links, catalog):
        monkeypatch.setattr(module, "materialize", written)
    steps.append(("result", plan(catalog.QUERIES[name](spark, DATA))))
    assert [step for step, _ in steps].count("notes") == 1 and [step for step, _ in steps].count("links") == 1
    for step, shown in steps:
        if "documents.parquet" in shown and step != "notes-told":  # that one holds few
            assert not [c for c in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", shown) if re.search(r"\btext#", c)], step
        assert step in ("notes", "notes-told") or not re.search(r"embeddings\.parquet", shown), step
