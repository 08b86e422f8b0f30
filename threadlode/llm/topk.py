"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Vectors are rotated to the eigenvectors of their second-moment matrix (the right singular vectors of all rows), where
the first few coordinates hold most of an inner product. Candidates are dealt into blocks by descending length. All
queries meet the longest block first; the k-th best score found there is a query's floor, and by |q| * |x| >= floor it
tells how long a candidate must be. Queries with like needs are put together, and only the groups of blocks that reach
their need are sent to them, so that the bound saves the shuffle as well as the products. Within a group, a block ends
a query's scan once |q| * |x| falls below its floor, and a candidate is scored exactly only if its partial sum plus the
product of the residual lengths reaches it. Bounds carry a slack for rounding, so nothing that could count is pruned.

Scores are exact integers at any size of the components: 64-bit sums where they can't overflow, and Python's integers
elsewhere. A score among a query's best that doesn't fit a long raises OverflowError.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlode.session import materialize

#: Rows in a block of candidates, blocks in a group that travels together, rows in a block of queries.
BLOCK, GROUP, QUERY_BLOCK = 2048, 4, 1024
#: Bytes of a block: long vectors make blocks of fewer rows.
BLOCK_BYTES = 4 << 20
#: Share of all vectors' squared length that the coordinates of a partial sum hold.
HEAD_SHARE = 0.8
#: Pairs scored exactly at a time.
PAIRS = 1 << 16
#: Lengths are sorted into this many classes a power of two.
CLASSES = 16
#: Lengths from here on aren't compared, as their products may leave the range of doubles: such rows are always scored.
LONGEST = 1e140
NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): components in double precision; null vectors and null or non-finite components are left out."""
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(ok).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly, or infinite beyond their range."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def _whole(x: float, scale: int) -> int:
    v = x * scale
    return math.floor(v) if math.isfinite(v) else int(x) * scale


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles, shorter ones padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _lengths(v: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow; infinite where they leave the range of doubles."""
    top = np.abs(v).max(1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(top > 0, np.where(np.isinf(top), np.inf, top * np.sqrt(((v / np.where((top > 0) & np.isfinite(top), top, 1)[:, None]) ** 2).sum(1))), 0.0)


def rotation(vectors: DataFrame, dims: int, scale: int) -> tuple[np.ndarray, int]:
    """Eigenvectors, strongest first, of the sum of outer products over all rows (dims x dims values reach the driver),
    and how many of them hold ``HEAD_SHARE`` of the squared lengths. Very long rows are shortened first."""

    def gram(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            m = floors(_matrix(batch.column("x"), dims), scale)
            m = np.nan_to_num(m, posinf=1e300, neginf=-1e300)
            m /= np.maximum(1.0, np.abs(m).max(1, initial=0) / 1e12)[:, None]
            total += m.T @ m
        yield pa.record_batch([np.arange(dims * dims, dtype=np.int64), total.ravel()], ["i", "g"])

    cells = vectors.select("x").mapInArrow(gram, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()
    matrix = np.zeros(dims * dims)
    matrix[cells["i"]] = cells["g"]
    values, turn = np.linalg.eigh(matrix.reshape(dims, dims))
    held = np.cumsum(np.maximum(values[::-1], 0))
    return turn[:, ::-1].copy(), min(dims, int(np.searchsorted(held, HEAD_SHARE * held[-1])) + 1)


class Side:
    """Queries or candidates: whole components as doubles and, where all products fit, as longs."""

    def __init__(self, raw: np.ndarray, turn: np.ndarray, first: int, scale: int):
        self.raw, self.v, self.scale = raw, floors(raw, scale), scale
        self.norm = _lengths(self.v)
        self.wild = ~(self.norm < LONGEST)
        self.top = np.abs(self.v).max(1, initial=0)
        self.longs = np.where(np.abs(self.v) < 2.0**62, self.v, 0).astype(np.int64)
        own = np.where(self.wild[:, None], 0, self.v) @ turn
        self.head, self.rest = own[:, :first], np.linalg.norm(own[:, first:], axis=1)

    def integers(self, row: int) -> list[int]:
        return [_whole(x, self.scale) for x in self.raw[row].tolist()]


def _exact(q: Side, x: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of rows i of q and j of x. Values outside a long become the largest or least one, which no
    score may be and which is refused if it's among the best."""
    out = np.empty(len(i), np.int64)
    dims = max(1, q.v.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        fits = ~(q.top[i] * x.top[j] * dims >= 2.0**62) & (q.top[i] < 2.0**62) & (x.top[j] < 2.0**62)
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.einsum("ij,ij->i", q.longs[i[part]], x.longs[j[part]])  # those that don't fit are replaced below
    for k in np.flatnonzero(~fits).tolist():
        s = sum(a * b for a, b in zip(q.integers(i[k]), x.integers(j[k]), strict=True))
        out[k] = min(max(s, -(2**63) + 1), 2**63 - 1)
    return out


def search_block(q: Side, q_ids: np.ndarray, blocks: list[tuple[np.ndarray, Side]], k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best k (scores, ids) for each query over ``blocks`` of (ids, candidates) in descending order of length. Scores below
    a query's ``least`` (NONE: any) don't matter and may be missing."""
    best, ids = np.full((len(q_ids), k), NONE), np.full((len(q_ids), k), np.iinfo(np.int64).max)
    as_floor = lambda s: np.where(s == NONE, -np.inf, s.astype(float))
    for x_ids, x in blocks:
        low = np.maximum(best[:, -1], least)
        floor, longest = as_floor(low), x.norm.max()
        wild = q.wild[:, None] | x.wild
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * np.where(q.wild, 0, q.norm) * min(longest, LONGEST) + 1e-6
            live = np.flatnonzero(q.wild | x.wild.any() | (np.where(q.wild, 0, q.norm) * min(longest, LONGEST) + slack >= floor))
        if not len(live):
            if (np.diff([b.norm.max() for _, b in blocks]) <= 0).all():
                break
            continue
        bound = q.head[live] @ x.head.T + np.outer(q.rest[live], x.rest) + slack[live, None]
        bound[wild[live]] = np.inf
        bound[q_ids[live][:, None] == x_ids] = -np.inf
        # the k best bounds are scored first: they raise the floor for the rest of the block
        few = min(k, len(x_ids))
        lead = np.argpartition(-bound, few - 1, axis=1)[:, :few]
        lead_scores = _exact(q, x, np.repeat(live, few), lead.ravel()).reshape(len(live), few)
        lead_scores[np.isneginf(np.take_along_axis(bound, lead, 1))] = NONE
        merged = np.maximum(np.sort(np.concatenate([best[live], lead_scores], 1), 1)[:, -k], low[live])
        i, j = np.nonzero((bound >= as_floor(merged)[:, None]) & ~np.isneginf(bound))
        rows, scores = live[i], _exact(q, x, live[i], j)
        keep = scores >= merged[i]
        rows, scores, found = rows[keep], scores[keep], x_ids[j[keep]]
        held = best[live] != NONE
        rows = np.concatenate([rows, live[np.nonzero(held)[0]]])
        scores, found = np.concatenate([scores, best[live][held]]), np.concatenate([found, ids[live][held]])
        order = np.lexsort((found, -scores, rows))
        rows, scores, found = rows[order], scores[order], found[order]
        runs = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
        rank = np.arange(len(rows)) - np.repeat(runs, np.diff(np.r_[runs, len(rows)]))
        take = rank < k
        best[rows[take], rank[take]], ids[rows[take], rank[take]] = scores[take], found[take]
    return best, ids


def norm_class(norm):
    """The class of a length; a column or an array."""
    if isinstance(norm, np.ndarray):
        return np.floor(np.log2(np.clip(norm, 1.0, LONGEST)) * CLASSES).astype(np.int64)
    return F.floor(F.log2(F.greatest(F.least(norm, F.lit(LONGEST)), F.lit(1.0))) * CLASSES)


def _blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(part, n, norm, ids, rows): blocks by descending length; ``norm`` is that of the longest."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))

    def lengths(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("vec_id"), batch.column("x"), pa.array(np.minimum(_lengths(floors(_matrix(batch.column("x"), dims), scale)), np.finfo(float).max))], ["vec_id", "x", "norm"])

    def blocks(batches):
        part, n, ids, rows, norm = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), np.zeros((0, dims)), np.zeros(0)
        for batch in batches:
            ids, norm = np.concatenate([ids, batch.column("vec_id").to_numpy()]), np.concatenate([norm, batch.column("norm").to_numpy()])
            rows = np.concatenate([rows, _matrix(batch.column("x"), dims)])
            while len(ids) >= size:
                yield block(part, n, norm[:size], ids[:size], rows[:size])
                ids, rows, norm, n = ids[size:], rows[size:], norm[size:], n + 1
        if len(ids):
            yield block(part, n, norm, ids, rows)

    def block(part, n, norm, ids, rows):
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int32()), [float(norm[0])], [ids.tobytes()], [rows.tobytes()]], ["part", "n", "norm", "ids", "rows"])

    measured = vectors.mapInArrow(lengths, "vec_id long, x array<double>, norm double")
    ordered = measured.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    return materialize(ordered.mapInArrow(blocks, "part int, n int, norm double, ids binary, rows binary"), "norm-blocks")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """For every vector whose vec_id is divisible by ``every``, the k best others: query_id, rank, vec_id, score.

    Components are floor(scale * x); scores are exact whatever their size, and one among the best that doesn't fit a long
    raises OverflowError. Ties go to the smaller vec_id. Null vectors and those with null or non-finite components take
    no part, nor do vectors with a null vec_id; empty vectors score 0. Shorter vectors count as padded with zeros. Rows
    that repeat a vec_id are one candidate each but never match their own id; as queries, equal rows count once and of
    different ones with the same vec_id the greatest is asked. Fewer candidates than k give fewer rows; an empty table
    gives none.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors).where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "x"), "components")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("x").alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("q")).first()
    if not size["n"] or not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, size["dims"])
    turn, first = rotation(rows, dims, scale)
    packed = _blocks(rows, dims, scale)
    made = lambda ids, data: (np.frombuffer(ids, np.int64), Side(np.frombuffer(data).reshape(-1, dims), turn, first, scale))
    longest = packed.orderBy(F.desc("norm"), "part", "n").select("part", "n", "ids", "rows").first()  # one block, at most BLOCK_BYTES

    def need(batches):
        """Each query's floor by the longest block, and the class of the shortest candidate that may reach it."""
        block = [made(longest["ids"], longest["rows"])]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = Side(_matrix(batch.column("x"), dims), turn, first, scale)
            floor = search_block(q, batch.column("vec_id").to_numpy(), block, k, np.full(batch.num_rows, NONE))[0][:, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(q.wild | (floor <= 0), 0.0, floor * (1 - 1e-8) / np.maximum(q.norm, 1e-9))
            yield pa.record_batch([batch.column("vec_id"), batch.column("x"), pa.array(floor), pa.array(norm_class(least))], ["vec_id", "x", "floor", "need"])

    def dealt(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = n + np.arange(batch.num_rows)
            n += batch.num_rows
            yield pa.record_batch([pa.array(np.full(batch.num_rows, part, np.int32)), pa.array((at // QUERY_BLOCK).astype(np.int32)), *(batch.column(c) for c in ("vec_id", "x", "floor", "need"))], ["q_part", "q_n", "vec_id", "x", "floor", "need"])

    needs = asked.mapInArrow(need, "vec_id long, x array<double>, floor long, need long").repartitionByRange(F.desc("need"), "vec_id").sortWithinPartitions(F.desc("need"), "vec_id")
    queries = materialize(needs.mapInArrow(dealt, "q_part int, q_n int, vec_id long, x array<double>, floor long, need long"), "queries")
    # a row a block of queries and a row a group of blocks meet by classes of length
    groups = packed.withColumn("g", F.expr(f"n div {GROUP}")).groupBy("part", "g").agg(norm_class(F.max("norm")).alias("class"))
    top = groups.agg(F.max("class")).first()[0]
    wanted = queries.groupBy("q_part", "q_n").agg(F.min("need").alias("need")).where(F.col("need") <= top)
    wanted = wanted.select("q_part", "q_n", F.explode(F.sequence(F.col("need"), F.lit(top))).alias("class"))
    pairs = materialize(wanted.join(groups, "class").select("q_part", "q_n", "part", "g"), "block-pairs")
    at = ["q_part", "q_n", "part", "g"]
    left = queries.join(pairs, ["q_part", "q_n"]).select(*at, "vec_id", "x", "floor")
    right = packed.withColumn("g", F.expr(f"n div {GROUP}")).join(pairs, ["part", "g"]).select(*at, "n", "ids", "rows")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        right = right.sort_values("n")
        raw = np.zeros((len(left), dims))
        for i, x in enumerate(left["x"]):
            raw[i, : len(x)] = x
        q_ids = left["vec_id"].to_numpy()
        blocks = [made(a, b) for a, b in zip(right["ids"], right["rows"], strict=True)]
        best, ids = search_block(Side(raw, turn, first, scale), q_ids, blocks, k, left["floor"].to_numpy())
        i, j = np.nonzero(best != NONE)
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[i, j], "score": best[i, j]})

    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a group of blocks
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    outside = (F.col("score") == 2**63 - 1) | (F.col("score") == -(2**63) + 1)
    score = F.when(outside, F.raise_error(F.lit("OverflowError: a score doesn't fit a long"))).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", score.cast("long").alias("score"))
