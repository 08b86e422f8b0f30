from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadlode.llm import fingerprints as fp


def _edited(docs):
    """Each row with its edited text and its next one's, in the order of the docstring; ties of doc_id aren't tested here but for equal rows."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, -(docs[k][0] or 0), docs[k][1] or ""))
    out = []
    for at, k in enumerate(order):
        a, b = docs[k][1] or "", docs[order[(at + 1) % len(order)]][1] or ""
        out.append((docs[k][0], a, a[: len(a) - len(a) // 2] + b[: len(a) // 2], b))
    return out


def _like(a, b):
    a, b = (Counter(re.findall(r"\w+", x.lower())) for x in (a, b))
    top, low = sum((a | b).values()), sum((a & b).values())
    return low / top if top else 1.0


def test_rows(spark):
    text = lambda k: " ".join(f"w{k * j % 31}é" for j in range(4 + k % 40))
    docs = [*[(k, text(k)) for k in range(40)], (5, text(5)), (5, text(5)), (None, "nameless one"), (-3, None), (-4, ""), (-5, "?!"), (90, "x"), (91, "𝒳y" * 300), (92, "long words " * 5000)]
    rows = spark.createDataFrame([(d, t, 1, False) for d, t in docs], "doc_id long, text string, n int, copy boolean")
    got = fp.fingerprints(rows).collect()
    want = _edited(docs)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted((str(d), len(a), hashlib.sha256(e.encode()).hexdigest()) for d, a, e, _ in want)
    by = {hashlib.sha256(e.encode()).hexdigest() + str(d): (a, e, b) for d, a, e, b in want}
    off = []
    for r in got:
        a, e, b = by[r["edited_sha256"] + str(r["doc_id"])]
        assert 0 <= r["near_edited"] <= 1 and len(r["fingerprint"]) == len(r["edited_fingerprint"]) == fp.SAMPLES * fp.DIGITS
        assert (a != e or r["near_edited"] == 1) and (a != b or r["near_next"] == 1)
        off += [r["near_edited"] - _like(a, e), r["near_next"] - _like(a, b)]
    assert abs(sum(off)) / len(off) < 0.03 and max(map(abs, off)) < 0.45
    shown = {}
    for r in got:
        assert shown.setdefault(by[r["edited_sha256"] + str(r["doc_id"])][0], r["fingerprint"]) == r["fingerprint"]
    words = [x for x in shown.values() if x != fp.NO_WORDS]
    assert len(set(words)) == len(words)


def test_collision_rate(spark):
    """Over many pairs of weighted bags the share of equal samples is generalised Jaccard similarity."""
    n = 300
    bags = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("w"))
    counts = bags.select("id", F.xxhash64(F.col("id") * 100 + F.col("w")).alias("term"), (F.col("w") % 4 + 1).alias("a"), (F.col("w") % 3 * 2).alias("b"))
    got = fp.samples(counts, ["id"], ["a", "b"]).select(F.avg(fp.likeness(F.col("a"), F.col("b")))).first()[0]
    low = sum(min(w % 4 + 1, w % 3 * 2) for w in range(1, 13))
    top = sum(max(w % 4 + 1, w % 3 * 2) for w in range(1, 13))
    assert abs(got - low / top) < 0.02  # a standard error of 0.005


@pytest.mark.parametrize("rows", [[], [(4, "only one here")]])
def test_few(spark, rows):
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["near_next"] == 1 for r in got)


def test_native(spark):
    df = fp.fingerprints(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
