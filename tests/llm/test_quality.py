from __future__ import annotations

import numpy as np

from tests.conftest import DATA
from threadlode.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string"


def test_held_out_accuracy(spark):
    d = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen, unseen = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.classify(docs, seen)
    assert got.count() == docs.count()
    rows = got.join(unseen, "doc_id").select("quality", "keep").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.15


def test_nulls_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (None, "a b " * 30000, "en", "s", -5, None), (3, "", "en", "s", 0, None)], DOCS)
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and all(r["keep"] and r["p_quality"] == 0.5 for r in got)
    both = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, both).count() == 4
    assert quality.classify(docs.limit(0), both).count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4


def test_views_exchange_pseudo_labels():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 400).astype(float)
    views = [np.stack([y + 0.3 * r.standard_normal(400), r.standard_normal(400)], 1) for _ in range(2)]
    truth = r.integers(0, 2, 400).astype(float)
    free = [np.stack([truth + 0.3 * r.standard_normal(400), r.standard_normal(400)], 1) for _ in range(2)]
    model = quality.co_train(views, y, free)
    p = quality.score(model, free[0], free[1])[2]
    assert ((p >= 0.5) == truth).mean() > 0.97
    assert len(model["views"]) == 2 and all(a >= 0 for a, _ in model["scales"])


def test_pseudo_labels_come_from_all_documents(spark, monkeypatch):
    """Against a plain choice over all distinct unlabelled documents; copies, null ids and labelled rows don't crowd it."""
    monkeypatch.setattr(quality, "MOVED", 6)
    r = np.random.default_rng(1)
    rows = [(k if k % 9 else None, "word " * int(r.integers(1, 40)) + "x!$" * int(r.integers(0, 20)), "en", f"s{k % 7}", int(r.integers(0, 500)), None) for k in range(300)]
    rows += [(1000 + k, *rows[150][1:]) for k in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(k, float(k % 2)) for k in range(1, 60)], "doc_id long, y double")
    table = quality.features(docs).selectExpr("*", "xxhash64(text_x, meta_x) AS key").cache()
    fitted = [(np.r_[r.standard_normal(n), 0.0], np.zeros(n), np.full(n, 0.1)) for n in (quality.N_TEXT, quality.N_META)]
    sure = quality._sure_of_all(table, marks)
    free = {(t["text_x"], t["meta_x"]) for t in table.collect() if t["doc_id"] is None or not 1 <= t["doc_id"] < 60}
    shares = {1.0: 4, 0.0: 2}
    for _ in range(2):
        got = sure(fitted, shares)
        used = set()
        for k, (x, labels) in enumerate(got):
            z = {pair: float(quality.predict(fitted[k], np.frombuffer(pair[k], np.float32)[None])[0]) for pair in free}
            for label, n in shares.items():
                sign = 1 if label else -1
                best = sorted((sign * v for v in z.values() if sign * v >= np.log(19)), reverse=True)[:n]
                mine = [(a.tobytes(), b.tobytes()) for a, b, t in zip(*x, labels, strict=True) if t == label]
                assert np.allclose(sorted((sign * z[m] for m in mine), reverse=True), best) and len({*mine}) == len(mine)
                used |= {*mine}
        free -= used
    table.unpersist()
