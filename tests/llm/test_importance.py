from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlode.llm import common, importance


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def _buckets(text, longest):
    w = _words(text)
    return sorted(zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in range(1, longest + 1) for k in range(len(w) - n + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["The", "a", "É", "É ", "x\x1cy", "\x85", "\xa0", "\t", " ", "_", "d-g", "B1G", "ſK"]), max_size=30).map("".join), st.integers(1, 4))
def test_ring(text, longest):
    n, got = importance.ring(common.word_runs(text.encode()), longest)
    assert n == len(_words(text)) and sorted(got) == _buckets(text, longest)


def test_long_texts_come_in_parts(monkeypatch):
    text = " ".join(f"word{k % 17}" for k in range(500)) + " " + "x" * 300
    monkeypatch.setattr(common, "WORDS_AT_ONCE", 40)
    assert sorted(importance.ring(common.word_runs(text.encode()), 3)[1]) == _buckets(text, 3)


def _brute(docs, target, least=20, percent=25):
    count = lambda texts: Counter(b for t in texts for b in _buckets(t, 2))
    s, t = count([x for _, x in docs]), count(target)
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000))))
    rows = []
    for d, x in docs:
        own = _buckets(x, 2)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = [k for k, (_, x) in enumerate(docs) if len(_words(x)) >= least]
    able.sort(key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0, rows[k][1], rows[k][2]))
    rank = {k: n + 1 for n, k in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, rank.get(k)) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("n", [0, 1, 60])
def test_odd_rows(spark, n):
    text = lambda k: " ".join(f"w{k * j % 23}" for j in range(15 + k % 12))
    docs = [*[(k, text(k)) for k in range(n)], *([(None, text(3)), (5, text(5)), (5, text(5)), (7, None), (8, ""), (9, "one " * 5000)] if n else [])]
    rows = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n_words long, down long")
    target = ["w1 w2 w3 w4", None, ""]
    got = importance.resample(rows, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(map(tuple, got), key=str) == _brute(docs, target)
