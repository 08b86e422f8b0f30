from __future__ import annotations

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlode.llm import simhash


def _fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["The", "a", "É", "É ", "x\x1cy", "\x85", "\xa0", "\t", " ", "\n", "dog", "BIG"]), max_size=30).map(" ".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _fingerprint(text)


def _components(keys):
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4
    label = np.arange(len(keys))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def _keys(r, n):
    base = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
    out = [base]
    for flips in range(1, 8):
        some = base[r.integers(0, n, n // 6)].copy()
        for _ in range(flips):
            some ^= np.uint64(1) << r.integers(0, 64, len(some)).astype(np.uint64)
        out.append(some)
    ball = base[0] ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64))  # a dense group
    return np.unique(np.concatenate([*out, ball, [np.uint64(0)]]))


def test_trie_join_finds_the_pairs_of_its_half():
    r = np.random.default_rng(3)
    keys = _keys(r, 300)
    every = np.arange(len(keys))
    parent = simhash.trie_links(keys, every, every, 0)
    turned = np.sort((keys << np.uint64(32)) | (keys >> np.uint64(32)))
    other = simhash.trie_links(turned, every, every, 0)
    # each pair within 4 bits is joined in one traversal at least
    a, b = np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4)
    back = np.searchsorted(turned, (keys << np.uint64(32)) | (keys >> np.uint64(32)))
    assert ((parent[a] == parent[b]) | (other[back[a]] == other[back[b]])).all()


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PREFIX_ROWS", 100)
    keys = _keys(np.random.default_rng(4), 500)
    rows = spark.createDataFrame([(k, int(x)) for k, x in enumerate(keys.view(np.int64).tolist())] + [(5000, int(keys.view(np.int64)[3]))], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.label_documents(rows).collect()}
    assert [got[k] for k in range(len(keys))] == _components(keys).tolist()
    assert got[5000] == got[3]


def test_documents_with_odd_rows(spark):
    long = "word " * 30000
    rows = [(9, "a b c d e f"), (4, "A  B\tc d e F"), (8, None), (6, "  \n"), (None, ""), (2, long), (1, long), (1, long), (3, "something else entirely here now")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fingerprint int")
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[9][2] == by[4][2] == 4 and by[8][2] == by[6][2] == by[None][2] == 6 and by[8][1] == "0" * 16 and by[2][2] == by[1][2] == 1 and by[3][2] == 3
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == [1, 3, 4, 6]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_unlike_documents_under_one_id_stay(spark):
    texts = [f"{w} stands alone among the documents of this small table" for w in ("first", "second", "third", "fourth")]
    texts = [f"{t} {' '.join(str(k * n) for n in range(20))}" for k, t in enumerate(texts, 3)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[1]), (8, texts[3])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, other int").repartition(3)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3])])
