from __future__ import annotations

import numpy as np
import pyarrow as pa

from threadlode.llm import passages


def test_compact_windows_against_brute_force():
    r = np.random.default_rng(5)
    sizes = np.array([60, 46, 200, 47])
    shingled = r.integers(0, 40, sizes.sum() + 9).astype(np.uint64)  # many ties
    starts = np.array([0, 63, 110, 313])
    of, c, left, right, _ = passages.compact_windows(shingled, starts, sizes, 1)
    got = sorted(zip(of.tolist(), c.tolist(), left.tolist(), right.tolist(), strict=True))
    want = []
    for d, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        t = shingled[s : s + n]
        h = passages._mix(t * np.uint64(passages._ODD[1]) + np.uint64(1)) >> np.uint64(32)
        for p in range(n):
            a = p
            while a > 0 and h[a - 1] > h[p]:
                a -= 1
            b = p
            while b < n - 1 and h[b + 1] >= h[p]:
                b += 1
            if b - a + 1 >= passages.LEAST:
                want.append((d, p, p - a, b - p))
    assert got == sorted(want)


def _words(r, n):
    return ["w" + str(x) for x in r.integers(0, 100_000, n)]


def test_planted_passages(spark):
    r = np.random.default_rng(6)
    docs, own = {}, {}
    shared = [_words(r, n) for n in (50, 80, 300)]
    for k in range(120):
        docs[k] = _words(r, int(r.integers(5, 400)))
    for s, ids in enumerate(((3, 50), (7, 8, 90), (20, 21, 22, 23))):
        for d in ids:
            at = int(r.integers(0, len(docs[d]) + 1))
            own.setdefault(d, []).append((at, at + len(shared[s])))
            docs[d][at:at] = shared[s]
    near = shared[2][:]
    near[40], near[200] = "changed", "changed"
    near.insert(120, "added")
    docs[200], own[200] = [*_words(r, 30), *near, *_words(r, 5)], [(30, 331)]
    docs[201], own[201] = docs[5] + _words(r, 60), []
    docs[202] = docs[201][:]  # exact copies
    short = _words(r, 40)  # too short for 50 words with a similarity of 0.8
    docs[203], docs[204] = [*short, *_words(r, 100)], [*_words(r, 10), *short]
    rows = [(k, " ".join(w)) for k, w in docs.items()] + [(300, None), (301, ""), (None, " ".join(shared[2])), (302, "the the " * 9000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_words int").repartition(3)
    got: dict = {}
    for x in passages.repeated_passages(df).collect():
        got.setdefault(x["doc_id"], []).append((x["start_word"], x["end_word"]))
        assert x["n_words"] == x["end_word"] - x["start_word"] >= 40 and x["other_id"] != x["doc_id"]
    for d, spans in own.items():
        for a, b in spans:
            assert any(x <= a + 6 and y >= b - 6 for x, y in got[d]), (d, a, b, got.get(d))
    assert got[202] == [(0, len(docs[202]))] == got[201]
    assert not {203, 204, 300, 301, 302} & {*got}
    clean = {*range(120)} - {*own} - {5}
    assert not clean & {*got}


def test_leaders_leave_no_window_alone():
    # windows of one signature: two far to the left, two far to the right; the groups don't fit each other
    key, doc = np.zeros(4, np.int64), np.arange(4)
    m, t = passages.lead(key, doc, np.zeros(4), np.array([45, 0, 45, 0]), np.array([0, 45, 0, 45]), np.full(4, 0x01010101))
    assert sorted(zip(m.tolist(), t.tolist(), strict=True)) == [(2, 0), (3, 1)]


def test_words_and_empty(spark):
    texts = pa.array(["  A b\tc\n", None, "", "x"], pa.string())
    hashed, counts = passages.tokens(texts)
    assert counts.tolist() == [3, 0, 0, 1] and len(hashed) == 4
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passage_twice_in_the_smallest_document(spark):
    r = np.random.default_rng(8)
    twice = _words(r, 60)
    docs = {0: [*_words(r, 30), *twice, *_words(r, 80), *twice, *_words(r, 30)]} | {k: [*_words(r, 40), *twice, *_words(r, 20)] for k in (1, 2)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    for parts in (1, 3):
        got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in passages.repeated_passages(df.repartition(parts, "doc_id")).collect()}
        assert got == {(0, 30, 90), (0, 170, 230), (1, 40, 100), (2, 40, 100)}


def test_line_that_many_share_hides_no_passage(spark):
    r = np.random.default_rng(9)
    line, docs, spans = _words(r, 40), {}, {}
    for k in range(60):
        before, after = _words(r, 30), _words(r, 30)
        if k % 2:  # shares ten more words with the document before it, on either side
            left = k // 2 % 11
            before[30 - left :], after[: 10 - left] = docs[k - 1][30 - left : 30], docs[k - 1][70 : 80 - left]
            spans[k] = spans[k - 1] = (30 - left, 80 - left)
        docs[k] = [*before, *line, *after]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    for parts in (1, 7):
        got = {x["doc_id"]: (x["start_word"], x["end_word"], x["other_id"]) for x in passages.repeated_passages(df.repartition(parts, "doc_id")).collect()}
        assert got == {k: (*s, k ^ 1) for k, s in spans.items()}


def _trios(r):
    """Three documents share a line, two of them also a passage around it: the cases in which a leader could hide a pair."""
    docs, spans = [], []
    for line, passage in ((30, 55), (40, 55), (44, 54)):
        for _ in range(60):
            whole = _words(r, passage)
            at = int(r.integers(0, passage - line + 1))
            for k in range(3):
                before = _words(r, int(r.integers(20, 60)))
                docs.append([*before, *(whole if k else whole[at : at + line]), *_words(r, int(r.integers(20, 60)))])
                spans.append((len(before), len(before) + passage) if k else None)
    return docs, spans


def test_exact_passages_are_never_hidden(spark):
    r = np.random.default_rng(11)
    docs, spans = _trios(r)
    ids = r.permutation(len(docs)).tolist()
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in zip(ids, docs, strict=True)], "doc_id long, text string")
    for parts in (1, 5):
        got = {x["doc_id"]: (x["start_word"], x["end_word"]) for x in passages.repeated_passages(df.repartition(parts, "doc_id")).collect()}
        assert got == {i: s for i, s in zip(ids, spans, strict=True) if s}


def _near_by_brute_force(a, b):
    """Whether two documents share a run of LEAST tokens with a similarity of 0.8, over every alignment."""
    x, y = (passages.shingles(passages.tokens(pa.array([" ".join(w)]))[0]) for w in (a, b))
    places: dict = {}
    for i, t in enumerate(x.tolist()):
        places.setdefault(t, []).append(i)
    return bool(passages.repeated(x, y, sorted({j - i for j, t in enumerate(y.tolist()) for i in places.get(t, [])})))


def test_recall_of_near_passages(spark):
    """One word changed, put in or left out, in half of the pairs around a line that all of those share: against all
    alignments of all pairs."""
    r = np.random.default_rng(12)
    line, docs = _words(r, 30), []
    for k in range(400):
        whole = _words(r, int(r.integers(50, 90)))
        if k % 2:
            at = int(r.integers(0, len(whole) - 30))
            whole[at : at + 30] = line
        other, at = whole[:], int(r.integers(5, len(whole) - 5))
        other[at : at + (k % 3 != 1)] = [f"new{k}"] * (k % 3 != 2)
        docs += [[*_words(r, 30), *x, *_words(r, 30)] for x in (whole, other)]
    true = {k ^ side for k in range(0, len(docs), 2) if _near_by_brute_force(docs[k], docs[k + 1]) for side in (0, 1)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string").repartition(5)
    got = {x["doc_id"] for x in passages.repeated_passages(df).collect()}
    assert len(true) > 600 and len(got & true) >= 0.98 * len(true) and not got - true


def test_repeated_ids_count_as_one_document(spark):
    r = np.random.default_rng(13)
    shared = _words(r, 60)
    rows = [(1, " ".join([*_words(r, 9), *shared])), (1, " ".join([*_words(r, 9), *shared])), (2, " ".join(_words(r, 80)))]
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
