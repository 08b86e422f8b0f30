"""Vectors as arrays: cosine, nearest neighbours, and the deterministic hash embedding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def nearest(notes: DataFrame, query: Sequence[float], k: int = 25, digits: int = 6) -> DataFrame:
    """(note_id, score) of the ``k`` notes nearest to ``query``, ties by id: a scan with a top-k, no index, no shuffle of vectors."""
    score = F.round(cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query])), digits)
    return notes.select("note_id", score.alias("score")).orderBy(F.desc("score"), "note_id").limit(k)


def hash_embedding(text: Column, dims: int = 8, normalized: bool = True) -> Column:
    """Component j: the first four bytes of sha256("j:text") scaled to [-0.5, 0.5), then unit length."""
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda j: F.conv(F.substring(F.sha2(F.concat(j.cast("string"), F.lit(":"), text), 256), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5,
    )
    if not normalized:
        return raw
    # as a lambda's variable the vector and its length are computed once, not for every component
    measured = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.get(F.transform(measured, lambda s: F.transform(s["v"], lambda x: x / s["n"])), F.lit(0))
