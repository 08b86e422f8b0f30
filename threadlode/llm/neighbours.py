"""Embedding near-dedup by NN-descent.

A neighbour graph is started from blocks of vectors that lie next to each other in several random-projection orders, and
is refined in rounds: around every vector its neighbours, and those that have it as one, are compared with each other,
and each keeps the best it meets. Where a whole list lies above the threshold (a saturated list), it is enlarged.
Rounds end when the lists hardly improve. Edges above the threshold, verified in double precision, give components.

Groups too dense for any list are settled exactly: vectors whose enlarged list is saturated as well are compared with all
others of their label that lie near enough to their group's centre, so that links to other components are found; within
each component all links are counted in blocks, so counts don't depend on the lists' lengths and no pair is ever written. Recall is audited against brute force for a sample
of vectors that grows with the table, as a mean per vector, sparse and dense ones apart; if it falls short, the search runs
again from further projections and adds to the graph, and in the end all vectors of a label are compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.llm.common import components
from threadlode.session import materialize

THRESHOLD = 0.93
#: Lists are held in half precision while searching; edges this much below the threshold are verified too.
SLACK = 0.004
LIST, ENLARGED = 8, 32
ORDERS, CODE_BITS = 5, 20
BLOCK, OVERLAP = 256, 64
#: Members of a neighbourhood that are compared at a time; larger neighbourhoods are split.
GROUP = 64
ROUNDS, GAIN = 4, 0.002
#: Vectors of a component that are compared in one task: up to eight blocks of 64 or more, then blocks of EXACT_BLOCK.
SMALL_BLOCK, EXACT_BLOCK = 64, 1024
#: Dense vectors of a cell, centres of cells and vectors that are compared in one task to find links across components.
CELL, CENTRES, ACROSS = 512, 2048, 8192
AUDITED, RECALL, SEARCHES = 300, 0.97, 2


def _half(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float16).reshape(len(data), -1).astype(np.float32) if data else np.zeros((0, 1), np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a label whose vector is finite, not null, not empty and not zero."""
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(ok).where(F.exists("embedding", lambda x: x != 0))


def _unit(batches):
    """(id, label, copies, unit vector in double precision, in half precision)."""
    for batch in batches:
        exact, half = [], []
        for row in batch.column("embedding").to_pylist():
            v = np.array(row, np.float64)
            v = v / np.abs(v).max()
            v /= np.sqrt(v @ v)
            exact.append(v.tobytes())
            half.append(v.astype(np.float16).tobytes())
        yield pa.record_batch([batch.column("id"), batch.column("label"), batch.column("copies"), pa.array(exact, pa.binary()), pa.array(half, pa.binary())], ["id", "label", "copies", "exact", "half"])


def _ordered(seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            data = batch.column("half").to_pylist()
            for dims in {len(x) for x in data}:
                if dims not in planes:
                    planes[dims] = np.random.default_rng(seed).standard_normal((dims // 2, ORDERS * CODE_BITS)).astype(np.float32)
                rows = [k for k, x in enumerate(data) if len(x) == dims]
                sides = (_half(pa.array([data[k] for k in rows], pa.binary())) @ planes[dims] > 0).reshape(len(rows), ORDERS, CODE_BITS)
                codes = (sides * (1 << np.arange(CODE_BITS)[::-1])).sum(2)
                own = batch.take(pa.array(rows))
                for t in range(ORDERS):
                    yield pa.record_batch([pa.array(np.full(len(rows), t, np.int32)), own.column("label"), pa.array(np.full(len(rows), dims, np.int32)), pa.array(codes[:, t].astype(np.int64)), own.column("id"), own.column("half")], ["t", "label", "dims", "code", "id", "half"])

    return run


def _best(sims: np.ndarray, ids: np.ndarray, others: np.ndarray):
    """Rows (id, other, sim) of the best LIST of each row of ``sims``."""
    few = min(LIST, sims.shape[1])
    at = np.argpartition(-sims, few - 1, axis=1)[:, :few] if few else np.zeros((len(ids), 0), int)
    got = np.take_along_axis(sims, at, 1)
    rows, cols = np.nonzero(got > -2)
    return ids[rows], others[at[rows, cols]], got[rows, cols]


def _near_in_order(batches):
    """Best neighbours within blocks of consecutive rows of the same order, label and length; blocks overlap."""
    held = None
    names = ["t", "label", "dims", "id"]

    def compare(rows):
        ids, v = rows[3], rows[4]
        s = v @ v.T
        np.fill_diagonal(s, -9)
        a, b, sim = _best(s, ids, ids)
        return pa.record_batch([a, b, sim.astype(np.float32)], ["a", "b", "sim"])

    def runs(rows):
        key = np.stack(rows[:3], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        return np.split(np.arange(len(key)), cuts)

    def matrix(batch):
        data = batch.column("half").to_pylist()
        out = np.empty(len(data), object)
        out[:] = data
        return [*(batch.column(x).to_numpy(zero_copy_only=False) for x in names), out]

    def emit(rows, final):
        """Compare what is complete; return what has to wait for the next batch."""
        groups = runs(rows)
        for g, at in enumerate(groups):
            last = g == len(groups) - 1
            i = 0
            while len(at) - i > BLOCK or ((not last or final) and i < len(at)):
                part = at[max(0, i - OVERLAP) : i + BLOCK]
                if len(part) > 1:
                    v = np.stack([np.frombuffer(x, np.float16) for x in rows[4][part]]).astype(np.float32)
                    yield compare([x[part] for x in rows[:4]] + [v])
                i += BLOCK
            if last and not final:
                rest[:] = [x[at[max(0, i - OVERLAP) :]] for x in rows]

    rest: list = []
    for batch in batches:
        rows = matrix(batch)
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        yield from emit(rows, False)
        held = [x for x in rest]
    if held is not None:
        yield from emit(held, True)


def _local_join(batches):
    """Compare the members of each neighbourhood; rows come sorted by (hub, part)."""
    held = None
    for batch in batches:
        rows = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("hub", "part", "id", "least")] + [_half(batch.column("half"))]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        held = [x[last] for x in rows]
        yield from _compare_groups([x[~last] for x in rows])
    if held is not None:
        yield from _compare_groups(held)


def _compare_groups(rows):
    hub, part, ids, least, v = rows
    if not len(hub):
        return
    first = np.flatnonzero(np.r_[True, (hub[1:] != hub[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[first, len(hub)])
    after = np.repeat(first + size, size) - np.arange(len(hub)) - 1  # members after each in its group
    ends = np.cumsum(after)
    at = 0
    while at < len(hub):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, "right")))
        n = after[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        sim = np.einsum("ij,ij->i", v[i], v[j])
        for x, y in ((i, j), (j, i)):
            good = (sim > least[x]) & (ids[x] != ids[y])
            if good.any():
                yield pa.record_batch([ids[x][good], ids[y][good], sim[good].astype(np.float32)], ["a", "b", "sim"])
        at = stop


def _lists(edges: DataFrame) -> DataFrame:
    """Rows (a, b, sim) of each list: the best LIST, or ENLARGED where those are all above the threshold."""
    once = edges.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    best = once.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False).alias("l"))
    full = F.coalesce(F.get("l", F.lit(LIST - 1))["sim"], F.lit(-1.0)) >= THRESHOLD - SLACK
    best = best.withColumn("l", F.slice("l", 1, F.when(full, F.lit(ENLARGED)).otherwise(F.lit(LIST)))).withColumn("full", full)
    # an enlarged list that has room takes whatever is above the threshold
    room = F.when(F.size("l") < LIST, F.lit(-1.0)).when(F.col("full") & (F.size("l") < ENLARGED), F.lit(THRESHOLD - SLACK))
    return best.select("a", F.explode("l").alias("x"), room.otherwise(F.element_at("l", -1)["sim"]).cast("float").alias("least")).select("a", "x.b", "x.sim", "least")


def descend(units: DataFrame, seed: int, known: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph (a, b, sim, least) of ``units(id, label, half)``."""
    dealt = units.select("id", "label", "half").mapInArrow(_ordered(seed), "t int, label long, dims int, code long, id long, half binary")
    order = ["t", "label", "dims", "code", "id"]
    start = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_near_in_order, "a long, b long, sim float")
    graph = materialize(_lists(start if known is None else start.union(known.select("a", "b", "sim"))), "neighbours")
    worth = graph.agg(F.sum("sim")).first()[0] or 0.0
    for _ in range(rounds):
        least = graph.groupBy(F.col("a").alias("id")).agg(F.min("least").alias("least"))
        back = graph.groupBy("b").agg(F.count("*").alias("n"))
        turned = graph.select("a", "b").join(back, "b")
        members = graph.select(F.col("a").alias("hub"), F.lit(0).cast("long").alias("part"), F.col("b").alias("id"))
        # those that name a hub: a hub named by very many is split
        parts = F.expr(f"n div {GROUP} + 1")
        members = members.union(turned.select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), parts).alias("part"), F.col("a").alias("id"))).distinct()
        full = members.join(least, "id").join(units.select("id", "half"), "id")
        joined = full.select("hub", "part", "id", "least", "half").repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(_local_join, "a long, b long, sim float")
        graph = materialize(_lists(graph.select("a", "b", "sim").union(joined)), "neighbours")
        now = graph.agg(F.sum("sim")).first()[0] or 0.0
        if now - worth <= GAIN * abs(now):
            break
        worth = now
    return graph


def _vectors(data) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _verified(graph: DataFrame, units: DataFrame) -> DataFrame:
    """Edges of the graph whose cosine reaches the threshold in double precision."""

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = _vectors(batch.column("x").to_pylist()), _vectors(batch.column("y").to_pylist())
                yield batch.select(["a", "b"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= THRESHOLD))

    near = graph.where(F.col("sim") >= THRESHOLD - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with_x = near.join(units.select(F.col("id").alias("a"), F.col("exact").alias("x")), "a")
    return with_x.join(units.select(F.col("id").alias("b"), F.col("exact").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")


def _saturated(graph: DataFrame) -> DataFrame:
    """(id) of vectors whose list is enlarged and full: they may have links that no list holds."""
    return graph.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.min("sim").alias("low")).where((F.col("n") >= ENLARGED) & (F.col("low") >= THRESHOLD - SLACK)).select("id")


def _across(members: DataFrame, dense: DataFrame) -> DataFrame:
    """Edges (a, b) that link components: for each vector of ``dense(id)`` and each component that has a link with it,
    one edge at least from that component to its own. ``members(id, label, component, exact)``.

    Dense vectors are dealt into cells by component. A vector can only link with a cell whose centre is within the cell's
    radius and the threshold's angle, so cells' centres are compared with all vectors of the label first, both in blocks.
    """
    all_ = members.select("id", "label", F.length("exact").alias("dims"), "component", "exact")
    own = all_.join(dense, "id")
    sized = own.join(own.groupBy("label", "dims", "component").agg(F.count("*").alias("size")), ["label", "dims", "component"])
    cell = F.pmod(F.xxhash64("id"), F.expr(f"size div {CELL} + 1")).cast("int")
    cells = materialize(sized.withColumn("cell", cell).drop("size"), "dense-cells")

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (label, dims, component, cell), g in pdf.groupby(["label", "dims", "component", "cell"], sort=False):
            v = _vectors(g["exact"].tolist())
            c = v.sum(0)
            size = np.sqrt(c @ c)
            c = c / size if size > 1e-9 else v[0]
            angle = np.arccos(np.clip((v @ c).min(), -1, 1)) + np.arccos(THRESHOLD)
            out.append((label, dims, component, cell, c.tobytes(), float(np.cos(min(np.pi, angle))) - 1e-7))
        return pd.DataFrame(out, columns=["label", "dims", "component", "cell", "exact", "reach"])

    task = F.pmod(F.xxhash64("component", "cell"), F.lit(4096))
    centres = materialize(cells.withColumn("task", task).groupBy("task").applyInPandas(centre, "label long, dims int, component long, cell int, exact binary, reach double"), "cell-centres")
    keys = ["label", "dims"]
    blocks = centres.groupBy(*keys).agg(F.expr(f"count(*) div {CENTRES} + 1").alias("centre_blocks"))
    blocks = blocks.join(all_.groupBy(*keys).agg(F.expr(f"count(*) div {ACROSS} + 1").alias("blocks")), keys)
    x = centres.join(blocks, keys).withColumn("cb", F.pmod(F.xxhash64("component", "cell"), F.col("centre_blocks"))).withColumn("vb", F.explode(F.expr("sequence(0L, blocks - 1)")))
    y = all_.join(blocks, keys).withColumn("vb", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("cb", F.explode(F.expr("sequence(0L, centre_blocks - 1)")))
    at = [*keys, "cb", "vb"]

    def near(c: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(c) and len(v):
            centres, reach, whose = _vectors(c["exact"].tolist()), c["reach"].to_numpy(), c["component"].to_numpy()
            for k in range(0, len(v), 1024):
                part = v.iloc[k : k + 1024]
                i, j = np.nonzero((_vectors(part["exact"].tolist()) @ centres.T >= reach) & (part["component"].to_numpy()[:, None] != whose))
                out.append(pd.DataFrame({"component": whose[j], "cell": c["cell"].to_numpy()[j], "id": part["id"].to_numpy()[i]}))
        return pd.concat(out) if out else pd.DataFrame({"component": [], "cell": [], "id": []})

    met = x.select(*at, "component", "cell", "exact", "reach").groupBy(*at).cogroup(y.select(*at, "id", "component", "exact").groupBy(*at))
    met = materialize(met.applyInPandas(near, "component long, cell int, id long"), "cells-met")
    parts = met.groupBy("component", "cell").agg(F.expr(f"count(*) div {ACROSS} + 1").alias("parts"))
    others = met.join(parts, ["component", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    others = others.join(all_.select("id", F.col("component").alias("other"), "exact"), "id")
    mine = cells.join(parts, ["component", "cell"]).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    at2 = ["component", "cell", "part"]

    def link(s: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": []})]
        if len(s) and len(v):
            ids, mine = s["id"].to_numpy(), _vectors(s["exact"].tolist())
            for k in range(0, len(v), 1024):
                part = v.iloc[k : k + 1024]
                sims = _vectors(part["exact"].tolist()) @ mine.T
                best = sims.argmax(1)
                good = sims[np.arange(len(part)), best] >= THRESHOLD
                out.append(pd.DataFrame({"a": part["id"].to_numpy(), "b": ids[best], "other": part["other"].to_numpy()})[good])
        found = pd.concat(out)
        return found.drop_duplicates("other")[["a", "b"]] if "other" in found else found

    return mine.select(*at2, "id", "exact").groupBy(*at2).cogroup(others.select(*at2, "id", "other", "exact").groupBy(*at2)).applyInPandas(link, "a long, b long")


def _joined(graph: DataFrame, units: DataFrame, exact: bool = False) -> DataFrame:
    """(node, component) over the graph's links, and over those that its saturated lists have no room for, or all."""
    edges = materialize(_verified(graph, units), "near-edges")
    joined = materialize(components(edges), "vector-components")
    dense = materialize(units.select("id") if exact else _saturated(graph), "saturated")
    if dense.limit(1).count() == 0:
        return joined
    members = units.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "label", F.coalesce("component", "id").alias("component"), "exact")
    more = materialize(_across(members, dense), "edges-across")
    if more.limit(1).count() == 0:
        return joined
    return materialize(components(edges.union(more)), "vector-components")


def _count_links(members: DataFrame) -> DataFrame:
    """(id, links): exact links of ``members(id, component, copies, exact)`` within their components."""
    sized = members.join(members.groupBy("component").agg(F.count("*").alias("size")), "component")
    blocks = F.expr(f"cast(greatest((size + {EXACT_BLOCK - 1}) div {EXACT_BLOCK}, least(8, (size + {SMALL_BLOCK - 1}) div {SMALL_BLOCK})) as int)")
    own = sized.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small components share tasks, large ones have a task for each pair of blocks
    shared = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(256))).otherwise(F.col("component"))
    dealt = dealt.select((F.col("blocks") > 1).alias("large"), shared.alias("task"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "component", "own", "id", "copies", "exact")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("component", sort=False):
            for _, same in g.groupby(g["exact"].str.len(), sort=False):
                ids, copies, v = same["id"].to_numpy(), same["copies"].to_numpy().astype(float), _vectors(same["exact"].tolist())
                own = same["own"].to_numpy()
                low, high = own == g["low"].iloc[0], own == g["high"].iloc[0]
                near = (v[low] @ v[high].T >= THRESHOLD).astype(float)
                if g["low"].iloc[0] == g["high"].iloc[0]:
                    np.fill_diagonal(near, 0)
                    out.append((ids, near @ copies))
                else:
                    out += [(ids[low], near @ copies[high]), (ids[high], near.T @ copies[low])]
        return pd.DataFrame({"id": np.concatenate([a for a, _ in out]), "links": np.concatenate([b for _, b in out]).astype(np.int64)})

    return dealt.groupBy("large", "task", "low", "high").applyInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(units: DataFrame, counted: DataFrame, sample: int | None = None) -> float:
    """Share of a vector's links that was found: the mean over those of ``sample`` vectors (first by hashed id) that have
    any, the lesser of the means of vectors with fewer than ENLARGED neighbours and of others; brute force on all rows."""
    sample = sample or max(AUDITED, 2 * int(np.sqrt(units.count())))
    rows = units.select("id", "label", "exact", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()
    if not rows:
        return 1.0
    asked = {}
    for r in rows:
        asked.setdefault((r["label"], len(r["exact"])), []).append((r["id"], np.frombuffer(r["exact"])))
    asked = {k: (np.array([i for i, _ in x]), np.stack([v for _, v in x])) for k, x in asked.items()}

    def brute(batches):
        for batch in batches:
            t = pd.DataFrame({x: batch.column(x).to_pylist() for x in ("id", "label", "exact", "copies")})
            for key, g in t.groupby(["label", t["exact"].str.len()]):
                if key in asked:
                    v, own, copies = _vectors(g["exact"].tolist()), g["id"].to_numpy(), g["copies"].to_numpy()
                    for k in range(0, len(asked[key][0]), 1024):
                        ids, q = (x[k : k + 1024] for x in asked[key])
                        near = (q @ v.T >= THRESHOLD) & (ids[:, None] != own)
                        yield pa.record_batch([ids, (near @ copies).astype(np.int64), near.sum(1)], ["id", "true", "others"])

    true = units.select("id", "label", "exact", "copies").mapInArrow(brute, "id long, true long, others long").groupBy("id").agg(F.sum("true").alias("true"), F.sum("others").alias("others"))
    share = F.least("true", F.coalesce("links", F.lit(0))) / F.col("true")
    got = true.where(F.col("true") > 0).join(counted, "id", "left").groupBy((F.col("others") >= ENLARGED).alias("dense")).agg(F.avg(share).alias("found")).collect()
    return min((r["found"] for r in got), default=1.0)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Vectors are compared only within a label and among equal lengths. Null, zero and empty vectors, those with null or
    non-finite components and those without a label link with nothing: no links, a component of their own, kept. Equal
    vectors link like any others and are handled once. Rows that repeat a vec_id are vectors each. A null vec_id takes
    part but is no component's id unless all its members' are null. An empty table gives no rows.
    """
    rows = materialize(vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").withColumn("row", F.monotonically_increasing_id()), "vectors")
    ok = usable(rows)
    same = ok.groupBy("label", "embedding").agg(F.min("row").alias("id"), F.count("*").alias("copies"))
    units = materialize(same.select("id", "label", "copies", "embedding").mapInArrow(_unit, "id long, label long, copies long, exact binary, half binary"), "units")
    graph, joined, counted = None, None, None
    for search in range(SEARCHES + 1):
        exact = search == SEARCHES  # all vectors of a label are compared in the end
        graph = graph if exact else descend(units, 11 + search, graph)
        joined = _joined(graph, units, exact)
        counted = materialize(_count_links(units.join(joined.withColumnRenamed("node", "id"), "id").select("id", "component", "copies", "exact")), "links")
        recall = audit(units, counted)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall of the links is {recall:.3f}, below {RECALL}")
    # rows take the links and the component of the one vector that stands for their copies
    of = ok.join(same.select("label", "embedding", "id", "copies"), ["label", "embedding"]).select("row", "vec_id", "id", "copies")
    of = of.join(joined.withColumnRenamed("node", "id"), "id", "left").join(counted, "id", "left")
    of = materialize(of.select("row", "vec_id", F.coalesce("component", "id").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    tops = of.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    named = of.join(tops, "group").select("row", "n_links", "component_id")
    out = rows.select("row", "vec_id").join(named, "row", "left")
    top = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), F.col("vec_id").eqNullSafe(top).alias("kept"))
