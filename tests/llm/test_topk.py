from __future__ import annotations

import numpy as np

from threadlode.llm import topk


def _brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in ok if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def _run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return sorted(tuple(r) for r in topk.top_k(df, **options).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    r = np.random.default_rng(2)
    rows = [(k, (r.standard_normal(24) * r.uniform(0.1, 3)).astype(np.float32).tolist()) for k in range(900)]
    rows += [(k, rows[k % 7][1]) for k in range(900, 960)]  # ties
    rows += [(1000, None), (1001, [float("nan")] * 24), (1050, [None] * 24), (1100, [0.0] * 24), (1150, []), (1200, [5.0, -3.0]), (None, [1.0] * 24)]
    assert _run(spark, rows) == _brute(rows)


def test_few_candidates_and_empty(spark):
    assert _run(spark, []) == []
    rows = [(0, [1.0, 0.5]), (1, [0.25, 0.25]), (50, [-1.0, 0.0])]
    assert _run(spark, rows) == _brute(rows)
    assert _run(spark, [(1, [1.0])]) == []


def _brute_doubles(rows, k=5):
    def whole(x):
        v = 256 * x
        return int(np.floor(v)) if np.isfinite(v) else int(x) * 256

    ints = [(i, [whole(float(x)) for x in v]) for i, v in rows]
    out = []
    for q, x in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in ints if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def test_large_components_are_exact(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e6, 0.0]), (2, [5e5, 0.0]), (3, [3e5, 0.0])]
    assert _run(spark, rows) == [(0, 1, 1, 65536000000), (0, 2, 2, 32768000000), (0, 3, 3, 19660800000)]
    # sums whose parts don't fit a long though the sums do, components that no double can multiply, ties far out
    rows = [(50, [0.0, 2.0**10 + 1, 2.0**10 + 1, 0.0]), (3, [0.0, 2.0**29, -(2.0**29), 1e300])]
    rows += [(k, [0.0, float(k % 5), 0.0, 1.7e308 if k % 2 else -1e20]) for k in range(60, 75)]
    rows += [(150, [2.0**28 + 1, -(2.0**28), 0.0, 0.0]), (4, [2.0**28 + 1, 2.0**28, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == _brute_doubles(rows)


def test_score_beyond_a_long_is_refused(spark):
    import pytest

    df = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_k(df).collect()


def test_blocks_out_of_reach_are_not_sent(spark, monkeypatch):
    """Long candidates along the queries: short ones can't reach the floor, and their blocks don't travel."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "GROUP", 1)
    seen = []
    keep = topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df, name, *a: seen.append((name, keep(df, name, *a))) or seen[-1][1])
    r = np.random.default_rng(4)
    rows = [(k, (np.r_[1.0, r.standard_normal(7) * 0.1] * (8.0 if k < 40 else 0.05)).tolist()) for k in range(1200)]
    assert _run(spark, rows) == _brute(rows)
    counts = {name: df.count() for name, df in seen}
    assert counts["block-pairs"] < counts["norm-blocks"] / 4
