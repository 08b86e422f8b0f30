from __future__ import annotations

import numpy as np
import pyarrow as pa

from threadlode.llm.common import bounded, components


def _brute(edges, nodes):
    label = {n: n for n in nodes}
    while True:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not moved:
            return label


def test_components(spark):
    r = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2)) if a != b]
    edges += [(k, k + 1) for k in range(1000, 1060)]  # a path
    edges += [(2000 + 7 * k % 90, 2000) for k in range(90) if 7 * k % 90]  # a star
    edges += edges[:5] + [(b, a) for a, b in edges[:5]]
    rows = spark.createDataFrame([*edges, (7, 7), (None, 3), (3, None)], "a long, b long")
    got = {x["node"]: x["component"] for x in components(rows).collect()}
    assert got == _brute(edges, {n for e in edges for n in e})
    assert components(rows.limit(0)).count() == 0


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch([pa.array(["x" * 1000] * 50 + ["y" * 100_000])], ["t"])
    parts = list(bounded(iter([batch]), 10_000))
    assert sum(p.num_rows for p in parts) == 51 and len(parts) > 10
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
