from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from threadlode.functions.ids import DAY_US
from threadlode.operators import clustering, themes

NOW = 1000 * DAY_US


def _status(spark, sessions, span, last, known=None):
    df = spark.createDataFrame([("t", sessions, span, last * DAY_US, "h", "Label")], "theme_id string, session_count long, span_days long, last_us long, content_hash string, label string")
    k = None if known is None else spark.createDataFrame([("h", known)], "content_hash string, known_status string")
    return themes.status(df, NOW, k).first()["status"]


def test_status(spark):
    assert _status(spark, 1, 50, 999) == "unknown" and _status(spark, 3, 13, 999) == "unknown"
    assert _status(spark, 2, 14, 990) == "open" and _status(spark, 2, 14, 900) == "dormant"
    assert _status(spark, 2, 14, 900, "resolved") == "resolved" and _status(spark, 2, 14, 990, "nonsense") == "open"


def test_unfinished_orders_and_mutes(spark):
    rows = [("a", "open", 2, 10, " Alpha "), ("b", "open", 5, 9, "beta"), ("c", "dormant", 9, 99, "gamma"), ("d", "resolved", 9, 99, "delta")]
    df = spark.createDataFrame(rows, "theme_id string, status string, session_count long, span_days long, label string")
    muted = spark.createDataFrame([("alpha",)], "label_lc string")
    ids = lambda *a, **k: [r["theme_id"] for r in themes.unfinished(df, *a, **k).collect()]
    assert ids() == ["b", "a"] and ids(muted) == ["b"] and ids(include_dormant=True) == ["c", "b", "a"]


def test_rollup_counts_members(spark):
    rows = [("n2", "t", "s:1", "s", 5, "b" * 60), ("n1", "t", "s:1", "s", None, "first words of a text that is much longer than forty"), ("n3", "t", "x:1", "x", 9 + DAY_US, "c"), ("n4", None, "x:1", "x", 1, "noise")]
    df = spark.createDataFrame(rows, "note_id string, theme_id string, session_id string, source string, created_us long, text string")
    r = themes.rollup(df).first()
    assert (r["session_count"], r["source_count"], r["first_us"], r["n_notes"], r["span_days"], r["note_ids"]) == (2, 2, 5, 3, 1, ["n1", "n2", "n3"])
    assert r["label"] == "first words of a text that is much" and themes.rollup(df).count() == 1


def test_theme_hash_is_of_the_set_and_needs_no_list(spark):
    rows = [(f"n{k:03d}", "hot" if k % 4 else f"t{k}", "s:1", "s", k, f"text {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "note_id string, theme_id string, session_id string, source string, created_us long, text string")
    hashes = lambda d: {r["theme_id"]: r["content_hash"] for r in themes.rollup(d).select("theme_id", "content_hash").collect()}
    want = hashes(df.coalesce(1))
    assert hashes(df.repartition(7).orderBy(F.desc("text"))) == want and len({*want.values()}) == 51
    parts = [[0] * 8, 0]
    for n, theme, *_, text in rows:
        if theme == "hot":
            h = hashlib.sha256(f"{n}:{text}".encode()).hexdigest()
            parts = [[a + int(h[8 * k : 8 * k + 8], 16) for k, a in enumerate(parts[0])], parts[1] + 1]
    assert want["hot"] == hashlib.sha256(",".join(map(str, [parts[1], *parts[0]])).encode()).hexdigest()
    changed = df.withColumn("text", F.when(F.col("note_id") == "n001", "another").otherwise(F.col("text")))
    got = hashes(changed)
    assert got["hot"] != want["hot"] and all(got[t] == want[t] for t in want if t != "hot")
    assert hashes(df.where("note_id <> 'n001'"))["hot"] != want["hot"] and hashes(df.limit(0)) == {}
    plan = themes.rollup(df).select("theme_id", "content_hash", "n_notes")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_two_angular_groups_and_noise():
    r = np.random.default_rng(0)
    base = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    v = np.concatenate([base[0] + 0.02 * r.standard_normal((5, 3)), base[1] + 0.02 * r.standard_normal((6, 3)), [[-1.0, -1.0, 1.0]]])
    labels = clustering.cluster(v, 4)  # neither group can split in two
    assert len(set(labels[:5])) == len(set(labels[5:11])) == 1 and labels[0] == 0 and labels[5] == 1 and labels[11] == -1
    assert (clustering.cluster(v[:1], 2) == -1).all() and (clustering.cluster(np.zeros((0, 3)), 2) == -1).all()
    assert len(clustering.cluster(np.ones((6, 3)), 2)) == 6


def test_cluster_notes_numbers_by_smallest_member(spark):
    rows = [("u", f"n{k}", [1.0, 0.001 * k] if k % 2 else [0.001 * k, 1.0]) for k in range(12)]
    got = {r["note_id"]: r["cluster"] for r in clustering.cluster_notes(spark.createDataFrame(rows, "user_id string, note_id string, vec array<double>"), 3).collect()}
    assert got["n0"] == 0 and got["n1"] == 1 and len(set(got.values())) == 2


def _plain_clusters(v, least):
    """The definition, slowly: single linkage by repeated scans, a condensed tree by sets, the most stable clusters."""
    v = v / (np.sqrt((v * v).sum(1)) + 1e-9)[:, None]
    n = len(v)
    d = np.sqrt(np.maximum(2 - 2 * v @ v.T, 0))
    groups, merges = [frozenset([k]) for k in range(n)], []
    while len(groups) > 1:
        dist, a, b = min((min(d[i, j] for i in x for j in y), p, q) for p, x in enumerate(groups) for q, y in enumerate(groups) if p < q)
        merges.append((groups[a], groups[b], dist))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] | groups[b]]
    split = {x | y: (x, y, dist) for x, y, dist in merges}

    def best(node, birth, root=False):
        """(stability, clusters) of the subtree whose cluster is born with ``node``."""
        own, here = 0.0, node
        while True:
            if here not in split:
                return own, [node]
            x, y, dist = split[here]
            scale = 1 / max(dist, 1e-12)
            big = [s for s in (x, y) if len(s) >= least]
            if len(big) == 2:
                own += (scale - birth) * len(here)
                kids = [best(s, scale) for s in (x, y)]
                below = sum(k[0] for k in kids)
                return (own, [node]) if own >= below and not root else (below, kids[0][1] + kids[1][1])
            own += (scale - birth) * sum(len(s) for s in (x, y) if s not in big)
            if not big:
                return own, [] if root else [node]
            here = big[0]

    out = np.full(n, -1)
    for k, c in enumerate(sorted(best(frozenset(range(n)), 0.0, True)[1], key=min)):
        out[list(c)] = k
    return out


def test_clusters_against_the_definition():
    r = np.random.default_rng(3)
    for trial in range(25):
        centres = r.standard_normal((int(r.integers(2, 5)), 4))
        v = centres[r.integers(0, len(centres), int(r.integers(12, 40)))]
        v = v + r.standard_normal(v.shape) * r.uniform(0.05, 0.4)
        least = int(r.integers(2, 5))
        assert (clustering.cluster(v, least) == _plain_clusters(v, least)).all(), trial


def test_deep_trees():
    v = np.array([[np.cos(0.8**k), np.sin(0.8**k)] for k in range(1500)])  # each point joins one by one
    assert len(clustering.cluster(v, 2)) == 1500


def test_a_pair_of_blocks_in_small_matrices():
    v = np.random.default_rng(6).standard_normal((40, 3))
    v[10:20] = v[10]
    for split in (None, 13, 40):
        want = clustering.block_tree(v, split)
        for side in (4, 15, 50):
            assert all((a == b).all() for a, b in zip(clustering.pair_tree(v, split, side), want)), (split, side)
    assert len(want[0]) == 0  # no row on the other side


def _notes(spark, users):
    rows = [(u, f"n{k:04d}", None if x is None else [float(c) for c in x]) for u, v in users.items() for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "user_id string, note_id string, vec array<double>").repartition(3)


def test_any_size_of_block_gives_the_same_clusters(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((6, 4))
    big = centres[r.integers(0, 6, 150)] + 0.2 * r.standard_normal((150, 4))
    big[20:50] = big[20]  # copies: distances of zero, and equal ones to all others
    users = {"big": big, "small": big[60:90], "two": big[:2], "one": big[:1]}
    want = {(u, f"n{k:04d}"): int(c) for u, v in users.items() for k, c in enumerate(clustering.cluster(v, 3))}
    assert len(set(want.values())) > 3
    for block in (7, 32, 64, 2048):  # 22 blocks, 5, 3 and one
        got = {(x["user_id"], x["note_id"]): x["cluster"] for x in clustering.cluster_notes(_notes(spark, users), 3, block).collect()}
        assert got == want, block


def test_blocks_against_the_definition(spark):
    r = np.random.default_rng(8)
    users = {}
    for trial in range(6):
        centres = r.standard_normal((3, 4))
        users[f"u{trial}"] = centres[r.integers(0, 3, 40)] + 0.3 * r.standard_normal((40, 4))
    got = {(x["user_id"], x["note_id"]): x["cluster"] for x in clustering.cluster_notes(_notes(spark, users), 3, 9).collect()}
    assert got == {(u, f"n{k:04d}"): int(c) for u, v in users.items() for k, c in enumerate(_plain_clusters(v, 3))}


def test_odd_notes_are_noise_and_too_many_an_error(spark):
    import pytest

    good = [[1.0, 0.001 * k] if k % 2 else [0.001 * k, 1.0] for k in range(12)]
    rows = _notes(spark, {"u": good + [None, [float("nan"), 1.0], [float("inf"), 0.0]], None: good})
    got = sorted((x["user_id"] or "", x["note_id"], x["cluster"]) for x in clustering.cluster_notes(rows, 3, 5).collect())
    assert len(got) == 27 and [c for _, n, c in got if n >= "n0012"] == [-1] * 3
    assert [c for u, n, c in got if u == ""] == [k % 2 for k in range(12)] == [c for u, n, c in got if u and n < "n0012"]
    assert clustering.cluster_notes(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="split them by time"):
        clustering.cluster_notes(rows, most=11)
