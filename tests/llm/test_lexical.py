from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from threadlode.llm import lexical


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low))


def _brute(docs, items, k):
    held = [(d, t) for d, x in docs if (t := _terms(x))]
    n_docs, n_terms = len(held), sum(sum(t.values()) for _, t in held)
    df = Counter(w for _, t in held for w in t)
    out = []
    for item, text in items:
        scores = []
        for d, t in held:
            m = 75 + 25 * sum(t.values()) * n_docs // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t[w] // (1000 * t[w] + 12 * m)) for w, times in _terms(text).items() if w in t)
            scores += [(-s, d is None, d or 0)] * (s > 0)
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def _rows(r, n):
    weights = 1 / np.arange(1, 80)
    some = lambda m: " ".join(f"w{k}" for k in r.choice(79, m, p=weights / weights.sum()))
    docs = [(int(k), some(int(r.integers(1, 40)))) for k in range(n)]
    return docs, [(k, some(6)) for k in range(12)]


@pytest.mark.parametrize("cells", [1 << 20, 30])
def test_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    docs, items = _rows(np.random.default_rng(cells), 300)
    docs += [(None, docs[4][1]), (4, docs[4][1]), (4, docs[4][1]), (900, None), (901, ""), (902, "w3 " * 4000), (903, "...")]
    items += [(3, "w70 W70 É"), (3, None), (None, "w1, w2"), (50, ""), (51, "nowhere")]
    rows = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, n long, item int").repartition(5)
    got = lexical.ranked_search(rows, spark.createDataFrame([(d, t, "x") for d, t in items], "item_id long, text string, terms string"), 7).collect()
    assert sorted(map(tuple, got), key=str) == _brute(docs, items, 7)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 5)
    docs, items = _rows(np.random.default_rng(1), 60)
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3).collect()
    assert sorted(map(tuple, got), key=str) == _brute(docs, items, 3)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs, items).count() == 0
    assert lexical.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_weak_terms_are_pruned():
    items = [(np.array([0, 1, 2]), np.array([1, 1, 1]))]
    asked = lexical.Asked(items, np.array([10, 20, 900]), np.array([5, 5, 90]), np.array([100, 100, 100]))
    assert asked.floor.tolist() == [81_000] and asked.live_term.tolist() == [2] and asked.weak.tolist() == [3_000]
