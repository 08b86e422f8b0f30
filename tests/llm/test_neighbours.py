from __future__ import annotations

import numpy as np

from threadlode.llm import neighbours


def _brute(rows):
    """vec_id -> (links, component, kept)"""
    ok = {}
    for k, (vec_id, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, float)
    near = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] / np.sqrt((ok[j] @ ok[j]) * (ok[k] @ ok[k])) >= 0.93] for k in ok}
    out = []
    for k, (vec_id, *_ ) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        top = min(rows[j][0] for j in seen)
        out.append((vec_id, len(near.get(k, [])), top, top == vec_id))
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, n_links int")


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows, n = [], 0

    def add(v, label):
        nonlocal n
        rows.append((n, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label))
        n += 1

    for k in range(500):
        v = r.standard_normal(16)
        add(v, k % 3)
        for _ in range({0: 1, 7: 3, 100: 120}.get(k, 0)):  # pairs, small groups, one dense group
            add(v + 0.05 * r.standard_normal(16), k % 3)
    v = r.standard_normal(16)
    for label in (0, 0, 0, 1, None):
        add(v, label)  # exact copies; another label doesn't link
    add(3 * v, 0)
    for bad in (None, [0.0] * 16, [1.0, float("nan")] + [0.0] * 14, [1.0, float("inf")] + [0.0] * 14, [None] + [1.0] * 15, [], [1.0, 2.0]):
        add(bad, 0)
    order = r.permutation(len(rows))
    got = sorted(tuple(x) for x in neighbours.near_vectors(_table(spark, [rows[k] for k in order])).collect())
    assert got == _brute(rows)


def test_empty_and_single(spark):
    assert neighbours.near_vectors(_table(spark, [])).count() == 0
    assert [tuple(x) for x in neighbours.near_vectors(_table(spark, [(5, [1.0, 2.0], 1)])).collect()] == [(5, 0, 5, True)]


def test_links_between_tight_groups(spark):
    r = np.random.default_rng(2)

    def unit(v):
        return v / np.linalg.norm(v)

    rows = []
    for label in range(3):
        one = unit(r.standard_normal(64))
        side = r.standard_normal(64)
        two = unit(0.95 * one + np.sqrt(1 - 0.95**2) * unit(side - (side @ one) * one))
        for centre in (one, two):  # cosine 0.999 inside, 0.95 across
            rows += [(unit(centre + 0.032 * unit(r.standard_normal(64))), label) for _ in range(100)]
        rows += [(unit(r.standard_normal(64)), label) for _ in range(50)]
    rows = [(k, [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows)]
    got = sorted(tuple(x) for x in neighbours.near_vectors(_table(spark, rows)).collect())
    assert got == _brute(rows)


def test_all_are_compared_where_searches_fall_short(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = []
    for k in range(120):
        v = r.standard_normal(16)
        rows += [(v + 0.02 * r.standard_normal(16), k % 2) for _ in range(1 + (k % 3 == 0))]
    rows = [(k, [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows)]
    search = neighbours.descend
    monkeypatch.setattr(neighbours, "descend", lambda units, *_: search(units, 1, rounds=0).where("false"))
    got = sorted(tuple(x) for x in neighbours.near_vectors(_table(spark, rows)).collect())
    assert got == _brute(rows)


def test_audit_sees_sparse_vectors_beside_a_dense_group(spark):
    r = np.random.default_rng(4)
    one = r.standard_normal(16)
    vectors = [one + 0.01 * r.standard_normal(16) for _ in range(60)]
    for _ in range(20):
        v = r.standard_normal(16)
        vectors += [v + 0.01 * r.standard_normal(16) for _ in range(2)]
    units = [(k, 0, 1, (v / np.linalg.norm(v)).tobytes()) for k, v in enumerate(vectors)]
    units = spark.createDataFrame(units, "id long, label long, copies long, exact binary")
    counted = spark.createDataFrame([(k, 59) for k in range(60)], "id long, links long")  # no pair's link
    assert neighbours.audit(units, counted) < neighbours.RECALL
