"""Quality classifier by co-training of two views.

* content view: shares of character groups, repetition and line statistics, and hashed byte pairs of the whole text;
* metadata view: language, source (hashed), and the recorded number of characters.

Both are logistic regressions fitted in numpy on the driver to at most ``LABELLED`` labelled documents, the first in the
order of hashed ids. In every round both views score all unlabelled documents, whose features are written once; each
labels those it is most sure of, good and bad ones in the proportion of the labels, copies once, and these ``MOVED`` go to
the other view's training set. Each view is then calibrated on held-out labelled documents, and all documents are scored by the sum of the calibrated log odds less one prior, so a view that knows
nothing adds nothing. All counts and features of a document cover its whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.llm.common import map_batches
from threadlode.session import materialize

#: Bound of the labelled sample that the classifier is fitted to.
LABELLED = 4000
#: Rounds, and the documents that a view passes to the other in each: so many at most, each at least so sure.
ROUNDS, SURE, MOVED = 3, 0.95, 200
PAIRS, SOURCES, LANGS = 256, 64, 16
#: Lowest probability of good quality that is kept; under one half, as losing a good document costs more than keeping a bad one.
KEEP_FROM = 0.3
#: Ridge penalties of the two views, and of the slope that calibrates them.
PENALTIES, SLOPE_PENALTY = (3.0, 30.0), 0.02
HELD_OUT = 4  # every fourth labelled document

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!", b"$%&#*|@^~<>{}[]=_+\\/", b"?;:'\"()-"]
_MIX = (np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PAIRS
N_TEXT = len(_GROUPS) + 6 + PAIRS
N_META = SOURCES + LANGS + 2


def text_features(text: str | None) -> np.ndarray:
    """Of a null or empty text: zeros."""
    out = np.zeros(N_TEXT, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    codes = np.frombuffer(raw, np.uint8)
    counts = np.bincount(codes, minlength=256)
    for k, group in enumerate(_GROUPS):
        out[k] = counts[list(group)].sum() / len(raw)
    words = raw.split()
    n = max(1, len(words))
    at = len(_GROUPS)
    out[at] = counts[128:].sum() / len(raw)
    out[at + 1] = len(set(words)) / n
    out[at + 2] = sum(map(bytes.__eq__, words[1:], words)) / n
    out[at + 3] = min(len(raw) / n, 30) / 30
    out[at + 4] = sum(map(bytes.isupper, words)) / n
    out[at + 5] = min(len(raw), 100_000) ** 0.25 / 18
    if len(codes) > 1:
        pairs = np.bincount(codes[:-1].astype(np.uint16) * np.uint16(256) + codes[1:], minlength=65536)
        out[at + 6 :] = np.sqrt(np.bincount(_MIX, weights=pairs, minlength=PAIRS) / len(codes))
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(N_META, np.float32)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[-2:] = (0, 1) if n_chars is None else (min(max(n_chars, 0), 10**6) ** 0.25 / 32, 0)
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_x, meta_x) of every row: float32 values as bytes."""

    def run(batches):
        for batch in batches:
            text = [text_features(t).tobytes() for t in batch.column("text").to_pylist()]
            meta = [meta_features(*x).tobytes() for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "text_x", "meta_x"])

    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return map_batches(need, run, "doc_id long, text_x binary, meta_x binary")


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), width)


def _odds(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised features: weights (bias last), mean, scale."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(float)
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge)
        w -= np.linalg.solve(h, a.T @ (p - y) + ridge * w)
    return w, mean, scale


def predict(fitted: tuple, x: np.ndarray) -> np.ndarray:
    w, mean, scale = fitted
    return ((x - mean) / scale) @ w[:-1] + w[-1]


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset that map scores to log odds."""
    w = np.zeros(2)
    a = np.stack([z, np.ones_like(z)], 1)
    for _ in range(25):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([SLOPE_PENALTY, 1e-3])
        w -= np.linalg.solve(h, a.T @ (p - y) + np.array([SLOPE_PENALTY, 1e-3]) * w)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(_odds(y.mean())))


def _sure_among(free: list[np.ndarray]):
    """``sure`` of ``co_train`` over the rows of two arrays; a row is taken once."""
    left = np.ones(len(free[0]), bool)

    def sure(fitted: list[tuple], shares: dict[float, int]) -> list[tuple]:
        out = []
        for f, x in zip(fitted, free, strict=True):
            p = _sigmoid(predict(f, x))
            rows = [np.flatnonzero(left & (np.abs(1 - label - p) >= SURE)) for label in shares]
            rows = [r[np.argsort(-np.abs(p[r] - 0.5), kind="stable")][:n] for r, n in zip(rows, shares.values(), strict=True)]
            out.append((np.concatenate(rows), np.repeat([*shares], [len(r) for r in rows])))
        for rows, _ in out:
            left[rows] = False
        return [([x[rows] for x in free], labels) for rows, labels in out]

    return sure


def co_train(views: list[np.ndarray], y: np.ndarray, free, rounds: int = ROUNDS) -> dict:
    """Fit both views; ``views`` are the features of labelled documents. ``free`` are those of unlabelled ones, or a function
    of the fitted views and of the number wanted of each label: for each view, both views' features of the documents it is
    surest of, and their labels."""
    held = np.arange(len(y)) % HELD_OUT == 0 if len(y) >= 40 else np.zeros(len(y), bool)
    xs, ys = [v[~held] for v in views], [y[~held]] * 2
    good = min(MOVED - 1, max(1, round(MOVED * float(y.mean()))))
    sure = free if callable(free) else _sure_among(free)
    fitted = [logistic(x, t, c) for x, t, c in zip(xs, ys, PENALTIES, strict=True)]
    for _ in range(rounds):
        news = sure(fitted, {1.0: good, 0.0: MOVED - good})
        if not any(len(labels) for _, labels in news):
            break
        for k, (found, labels) in enumerate(news):
            xs[1 - k], ys[1 - k] = np.vstack([xs[1 - k], found[1 - k]]), np.concatenate([ys[1 - k], labels])
        fitted = [logistic(x, t, c) for x, t, c in zip(xs, ys, PENALTIES, strict=True)]
    test = held if held.any() else ~held
    scales = [calibrate(predict(f, v[test]), y[test]) for f, v in zip(fitted, views, strict=True)]
    return {"views": fitted, "scales": scales, "prior": float(_odds(y.mean()))}


def score(model: dict | None, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good quality by content, by metadata and by both."""
    if model is None:
        half = np.full(len(text_x), 0.5)
        return half, half, half
    z = [a * predict(f, x) + b for f, x, (a, b) in zip(model["views"], (text_x, meta_x), model["scales"], strict=True)]
    return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(z[0] + z[1] - model["prior"])


def _sure_of_all(table: DataFrame, marks: DataFrame):
    """``sure`` of ``co_train`` over all rows of ``table(key, doc_id, text_x, meta_x)`` whose doc_id has no mark."""
    taken: list[int] = []

    def sure(fitted: list[tuple], shares: dict[float, int]) -> list[tuple]:
        def run(batches):
            for batch in batches:
                z = [predict(f, _matrix(batch.column(c).to_pylist(), n)) for f, c, n in zip(fitted, ("text_x", "meta_x"), (N_TEXT, N_META), strict=True)]
                yield pa.record_batch([batch.column("key"), batch.column("doc_id"), *(pa.array(v) for v in z)], ["key", "doc_id", "z0", "z1"])

        scored = map_batches(table, run, "key long, doc_id long, z0 double, z1 double").join(marks.select("doc_id"), "doc_id", "left_anti")
        # equal features are scored alike: copies count once
        once = materialize(scored.where(~F.col("key").isin(taken)).groupBy("key").agg(F.max("z0").alias("z0"), F.max("z1").alias("z1")), "quality-scores")
        bound, best = float(_odds(SURE)), []
        for k in range(2):
            for label, n in shares.items():
                odds = F.col(f"z{k}") * (1 if label else -1)
                best.append(once.where(odds >= bound).orderBy(odds.desc(), "key").limit(n).select("key", F.lit(k).alias("view"), F.lit(label).alias("label")))
        picked = best[0].union(best[1]).union(best[2]).union(best[3]).collect()  # at most 2 MOVED rows
        keys = sorted({r["key"] for r in picked})
        taken.extend(keys)
        found = table.where(F.col("key").isin(keys)).groupBy("key").agg(F.min(F.struct("text_x", "meta_x")).alias("x")).select("key", "x.*").collect()
        x = {r["key"]: (r["text_x"], r["meta_x"]) for r in found}
        out = []
        for k in range(2):
            mine = [r for r in picked if r["view"] == k]
            out.append(([_matrix([x[r["key"]][v] for r in mine], n) for v, n in enumerate((N_TEXT, N_META))], np.array([r["label"] for r in mine])))
        return out

    return sure


def _fit(docs: DataFrame, labels: DataFrame, labelled: int) -> tuple[dict | None, DataFrame | None]:
    """The model, and the features of all rows where they were written."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("double")).alias("y"))
    ends = marks.agg(F.min("y"), F.max("y")).first()
    if ends[0] == ends[1]:
        return None, None
    table = materialize(features(docs).withColumn("key", F.xxhash64("text_x", "meta_x")), "quality-features")
    known = table.join(marks, "doc_id", "left_semi").select("doc_id").distinct().join(marks, "doc_id")
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))  # at most ``labelled`` rows
    # of several rows with one doc_id, that with the least features
    rows = table.join(some, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text_x", "meta_x")).alias("x")).select("doc_id", "y", "x.*").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    y = rows["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None, table
    return co_train([_matrix(rows[c].tolist(), n) for c, n in (("text_x", N_TEXT), ("meta_x", N_META))], y, _sure_of_all(table, marks)), table


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict | None:
    """None if there are no labels of these documents, or labels of one sort only."""
    return _fit(docs, labels, labelled)[0]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM, model: dict | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, p_text, p_meta, p_quality, keep (p_quality >= threshold).

    ``docs`` needs doc_id, text, lang, source and n_chars, any of them null; a null text counts as empty. Labels that are
    null are ignored, of several for one document the greatest counts. Without labels of both sorts every probability is
    0.5 and every document is kept. Rows that repeat a doc_id are scored each, and one of them, whichever has the least
    features, is learnt from; rows without a doc_id are unlabelled. An empty table gives no rows.
    """
    table = None
    if model is None:
        model, table = _fit(docs, labels, LABELLED)

    def run(batches):
        for batch in batches:
            p = score(model, *(_matrix(batch.column(c).to_pylist(), n) for c, n in (("text_x", N_TEXT), ("meta_x", N_META))))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(v) for v in p), pa.array(p[2] >= threshold)], ["doc_id", "p_text", "p_meta", "p_quality", "keep"])

    return map_batches(features(docs) if table is None else table, run, "doc_id long, p_text double, p_meta double, p_quality double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all columns, in one pass over the texts."""
    model = fit(docs, labels)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text = np.stack([text_features(t) for t in batch.column("text").to_pylist()])
            meta = np.stack([meta_features(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)])
            yield batch.filter(pa.array(score(model, text, meta)[2] >= threshold)).select(columns)

    return map_batches(docs, run, docs.schema)
