"""Density clustering of unit vectors: HDBSCAN with min_samples 1, where mutual reachability is plain distance.

It then is single linkage, a condensed tree, and the choice of the most stable clusters, the root excluded. Clusters are
numbered by their smallest member.

The n^2 distances are looked at once, in pairs of blocks of notes, each pair a task of its own with matrices of fixed size.
A pair keeps the spanning tree of its own distances: an edge that isn't the shortest way anywhere in a part isn't in the
whole either, so the trees of all pairs hold the tree of all. Trees of neighbouring pairs are then joined, four at a time,
until one is left. Only that tree, three numbers a note, meets in one task, which condenses it.

Edges have one order: 1 - cosine rounded to ``1 / STEPS``, then the two notes. So equal distances and the way the products
were blocked change nothing: any size of block gives the same clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlode.session import materialize

#: Notes of a block, and of a side of the matrix of long integers, 32 MB, that a task holds at a time.
BLOCK, SIDE = 8192, 2048
#: Notes of one user whose tree a task condenses, at some 200 bytes a note; beyond it an error is raised, and the caller has to split by time.
MOST_NOTES = 5_000_000
#: Steps of 1 - cosine; with two positions of 12 bits each, an edge is one long integer.
STEPS, BITS = 1e11, 12
FAR = np.iinfo(np.int64).max


def _top(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_tree(v: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, i, j) of the least spanning forest over the distances of all rows of ``v``, or of those between its first ``split`` rows and
    the others. Each round takes the shortest edge out of every part."""
    n = len(v)
    if n > 1 << BITS:
        raise ValueError(f"{n} rows: positions have {BITS} bits")
    v = v / (np.sqrt((v * v).sum(1)) + 1e-9)[:, None]
    at = np.arange(n)
    rows, cols = (at, at) if split is None else (at[:split], at[split:])
    key = np.rint(np.maximum(1 - v[rows] @ v[cols].T, 0) * STEPS).astype(np.int64) << (2 * BITS)
    key |= (np.minimum(rows[:, None], cols[None, :]) << BITS) | np.maximum(rows[:, None], cols[None, :])
    parent, part, edges = list(range(n)), at, []
    while key.size:
        key[part[rows][:, None] == part[cols][None, :]] = FAR
        best = np.full(n, FAR)
        np.minimum.at(best, part[rows], key.min(1))
        np.minimum.at(best, part[cols], key.min(0))
        found = np.unique(best[best < FAR])
        if not len(found):
            break
        edges.append(found)
        for e in found.tolist():
            parent[_top(parent, e >> BITS & (1 << BITS) - 1)] = _top(parent, e & (1 << BITS) - 1)
        part = np.array([_top(parent, x) for x in range(n)])
    e = np.sort(np.concatenate(edges)) if edges else np.zeros(0, np.int64)
    return e >> (2 * BITS), e >> BITS & (1 << BITS) - 1, e & (1 << BITS) - 1


def joined_tree(steps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions, shortest first, of the edges that are in the least spanning forest of all given ones."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)].tolist(), ends[len(a) :].tolist()
    parent, kept = list(range(len(ids))), []
    for k in np.lexsort((b, a, steps)).tolist():
        x, y = _top(parent, left[k]), _top(parent, right[k])
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def pair_tree(v: np.ndarray, split: int | None = None, side: int = SIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``block_tree``, for any number of rows: the trees of ``side`` x ``side`` distances, joined."""
    n = len(v)
    parts = [np.arange(at, min(at + side, end)) for begin, end in ((0, split or 0), (split or 0, n)) for at in range(begin, end, side)]
    edges = [np.zeros((3, 0), np.int64)]
    for k, x in enumerate(parts):
        for y in parts[k:] if split is None else parts[k + 1 :]:
            if split is not None and (x[0] < split) == (y[0] < split):
                continue
            own = x is y
            at = x if own else np.concatenate([x, y])
            steps, i, j = block_tree(v[at], None if own else len(x))
            edges.append(np.stack([steps, at[i], at[j]]))
    steps, a, b = np.concatenate(edges, axis=1)
    kept = joined_tree(steps, a, b)
    return steps[kept], a[kept], b[kept]


def merges_of(steps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges (left, right, distance, size) of a tree over 0..n-1 whose edges come shortest first."""
    n = len(steps) + 1
    parent, size = list(range(2 * n - 1)), [1] * (2 * n - 1)
    out = np.zeros((n - 1, 4))
    distance = np.sqrt(2 * steps / STEPS)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = _top(parent, i), _top(parent, j)
        parent[x] = parent[y] = n + k
        size[n + k] = size[x] + size[y]
        out[k] = x, y, distance[k], size[n + k]
    return out


def condensed_labels(merges: np.ndarray, n: int, least: int) -> np.ndarray:
    """Cluster of each point, -1 for noise: stability is the sum over points of 1/leave - 1/birth."""
    size = lambda x: 1 if x < n else int(merges[x - n, 3])

    def points(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += [int(merges[y - n, 0]), int(merges[y - n, 1])]
        return out

    births, stability, kids, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while True:
            if node < n:
                # a point is left on its own: it stays with the cluster to the end of its scale
                members[c].append(node)
                break
            a, b, d = int(merges[node - n, 0]), int(merges[node - n, 1]), merges[node - n, 2]
            scale = 1 / max(d, 1e-12)
            big = [x for x in (a, b) if size(x) >= least]
            if len(big) == 2:
                stability[c] += (scale - births[c]) * size(node)
                for x in big:
                    k = len(births)
                    births[k], stability[k], kids[k], members[k] = scale, 0.0, [], []
                    kids[c].append(k)
                    todo.append((x, k))
                break
            for x in (a, b):
                if x not in big:
                    own = points(x)
                    stability[c] += (scale - births[c]) * len(own)
                    members[c] += own
            if not big:
                break
            node = big[0]
    chosen, best = set(), dict(stability)
    for c in sorted(births, reverse=True):
        below = sum(best[k] for k in kids[c])
        if c != 0 and (not kids[c] or stability[c] >= below):
            chosen.add(c)
        else:
            best[c] = below
    labels = np.full(n, -1)

    def spread(c: int) -> None:
        below = [c]
        while below:
            k = below.pop()
            labels[members[k]] = c
            below += kids[k]

    todo_c, picked = [0], []
    while todo_c:
        c = todo_c.pop()
        if c in chosen:
            picked.append(c)
            spread(c)
        else:
            todo_c += kids[c]
    named = np.flatnonzero(labels >= 0)
    found, first = np.unique(labels[named], return_index=True)
    number = np.full(len(births), -1)
    number[found[np.argsort(first)]] = np.arange(len(found))
    return np.where(labels >= 0, number[labels], -1)


def cluster(v: np.ndarray, least: int) -> np.ndarray:
    """Clusters of vectors that one task holds."""
    if len(v) < max(least, 2):
        return np.full(len(v), -1)
    return condensed_labels(merges_of(*pair_tree(v)), len(v), least)


def _numbered(notes: DataFrame) -> DataFrame:
    """Notes with ``_n``, their place by (user_id, note_id) among all, written once: parts of the range are sorted and counted on their own."""
    parts = notes.repartitionByRange("user_id", "note_id").sortWithinPartitions("user_id", "note_id").withColumn("_id", F.monotonically_increasing_id())
    parts = materialize(parts.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "notes")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of the range, not per note
    before = sizes.select("_part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_before"))
    return parts.join(before, "_part").withColumn("_n", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


EDGES = "first long, last long, low long, high long, steps long, a long, b long"


def _pair(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_n")
    low, high, ids = pdf["low"].iloc[0], pdf["high"].iloc[0], pdf["_n"].to_numpy()
    steps, i, j = pair_tree(np.array(pdf["vec"].tolist(), float), None if low == high else int((pdf["own"] == low).sum()))
    return pd.DataFrame({"first": pdf["first"].iloc[0], "last": pdf["last"].iloc[0], "low": low, "high": high, "steps": steps, "a": ids[i], "b": ids[j]})


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[joined_tree(pdf["steps"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy())]


def spanning_trees(numbered: DataFrame, blocks: int, block: int = BLOCK) -> DataFrame:
    """(first, last, low, high, steps, a, b): candidates for the tree of each user, at most two trees' worth; of ``numbered``
    (_n, first, last, vec), where a user's notes are numbered first..last and fill ``blocks`` blocks at most."""
    own = numbered.select("_n", "first", "last", "vec", F.expr(f"(_n - first) div {block}").alias("own"), F.expr(f"(last - first) div {block}").alias("most"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "most")))
    dealt = dealt.select("_n", "first", "last", "vec", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    edges = dealt.groupBy("first", "low", "high").applyInPandas(_pair, EDGES)
    for _ in range(max(0, (blocks - 1).bit_length() - 1)):
        edges = edges.withColumn("low", F.expr("low div 2")).withColumn("high", F.expr("high div 2"))
        edges = edges.groupBy("first", "low", "high").applyInPandas(_joined, EDGES)
    return edges


def cluster_notes(notes: DataFrame, least: int | None = None, block: int = BLOCK, most: int = MOST_NOTES) -> DataFrame:
    """(user_id, note_id, cluster) of notes (user_id, note_id, vec); -1 is noise.

    ``least`` members make a cluster (unset: by the user's notes). A vector that is null or holds null or non-finite components is
    noise and counts for nothing. Rows that repeat a note are notes of their own, and a null user is a user.
    """
    own = notes.select("user_id", "note_id", F.col("vec").cast("array<double>").alias("vec"))
    whole = F.expr("coalesce(forall(vec, x -> coalesce(not isnan(x) and abs(x) < double('Infinity'), false)), false)")
    rows = _numbered(own.where(whole))
    spans = rows.groupBy("user_id").agg(F.min("_n").alias("first"), F.max("_n").alias("last"))
    longest = spans.agg(F.max(F.col("last") - F.col("first") + 1)).first()[0] or 0
    if longest > most:
        raise ValueError(f"{longest} notes of one user: split them by time into parts of {most} at most")
    spans = spans.select(F.col("user_id").alias("_user"), "first", "last")
    trees = spanning_trees(rows.join(spans, F.col("user_id").eqNullSafe(F.col("_user"))), -(-longest // block), block)

    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        first, n = int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0] - pdf["first"].iloc[0] + 1)
        size, tree = least or max(2, min(8, n // 400)), _joined(pdf)
        steps, a, b = (tree[c].to_numpy() for c in ("steps", "a", "b"))
        labels = condensed_labels(merges_of(steps, a - first, b - first), n, size) if n >= size else np.full(n, -1)
        return pd.DataFrame({"_n": first + np.arange(n), "cluster": labels})

    found = trees.groupBy("first").applyInPandas(condense, "_n long, cluster int")
    noise = F.lit(-1).alias("cluster")
    labelled = rows.join(found, "_n", "left").select("user_id", "note_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return labelled.unionByName(own.where(~whole).select("user_id", "note_id", noise))
