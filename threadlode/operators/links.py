"""Similar notes across themes: a thresholded self-join on cosine, its weights and its rollups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlode.functions.ids import DAY_US, gap_days, link_id
from threadlode.functions.vectors import EPSILON
from threadlode.session import materialize

FLOOR, TIME_WEIGHT, SOURCE_WEIGHT, TOP, BLOCK = 0.6, 1.0, 0.5, 200, 4096
#: Notes that are written together as one row.
PACK = 4096
#: Rows of a pack that are multiplied at a time, at most.
STRIP = 256
#: No ids; of a plain empty list Arrow makes no strings.
NONE = np.zeros(0, object)
PAIR = "a string, b string, sim double"


def _packs(notes: DataFrame, pack: int, *others: str) -> DataFrame:
    """Rows of about ``pack`` notes each, by hash, with vectors of unit length as bytes; written, so each vector is shuffled and written once.

    A note without an id or a vector has no links."""
    notes = notes.where("note_id is not null and vec is not null").select("note_id", "theme_id", "vec", *[F.col(c).cast("double").alias(c) if c == "created_us" else c for c in others])
    packs = max(1, -(-notes.count() // pack))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["vec"].tolist(), np.float64)
        v = v / (np.sqrt((v * v).sum(1)) + EPSILON)[:, None]
        return pd.DataFrame({"pack": [int(pdf["pack"].iloc[0])], "vec": [v.tobytes()]} | {c: [pdf[c].to_numpy()] for c in ("note_id", "theme_id", *others)})

    types = dict(notes.dtypes)
    schema = ", ".join(["pack int", "vec binary", *(f"{c} array<{types[c]}>" for c in ("note_id", "theme_id", *others))])
    dealt = notes.withColumn("pack", F.pmod(F.xxhash64("note_id"), F.lit(packs)).cast("int"))
    return materialize(dealt.groupBy("pack").applyInPandas(gather, schema), "note-packs")


def _met(low: DataFrame, high: DataFrame | None = None) -> DataFrame:
    """Each pack with each of ``high``, or each two packs once. Packs are rows of a written table and pairs of them those of a
    cross join, whose tasks read both sides where they lie: nothing is copied to a pair, so nothing that is shuffled grows with the pairs."""
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    both = side(low, "low").crossJoin(side(low if high is None else high, "high"))
    return both.where("low_pack <= high_pack") if high is None else both.withColumn("high_pack", F.lit(None).cast("int"))


def _compared(batches: Iterator[pa.RecordBatch], floor: float, strip: int, *others: str):
    """For each strip of each two packs: the columns of both, positions (p, q) in them of the pairs, p before q by note_id, and their cosines.

    ``packs`` are the numbers and sizes of the two, whose columns follow each other."""
    for batch in batches:
        for r in range(batch.num_rows):
            cell = lambda c: batch.column(c)[r]  # noqa: B023, E731
            both = {c: pa.concat_arrays([cell(f"low_{c}").values, cell(f"high_{c}").values]) for c in ("note_id", "theme_id", *others)}
            n = len(cell("low_note_id").values)
            both["packs"] = [(cell("low_pack").as_py(), n), (cell("high_pack").as_py(), len(both["note_id"]) - n)]
            v, w = (np.frombuffer(cell(f"{p}_vec").as_buffer()).reshape(m, -1) for p, (_, m) in zip(("low", "high"), both["packs"]))
            order = pc.rank(both["note_id"], tiebreaker="dense").to_numpy()
            theme = pd.factorize(both["theme_id"].to_numpy(zero_copy_only=False), use_na_sentinel=True)[0]
            same = cell("low_pack").equals(cell("high_pack"))
            for at in range(0, n, strip):
                sim = v[at : at + strip] @ w.T
                i, j = np.nonzero(sim >= floor - 1e-9)
                s, i, j = sim[i, j], at + i, n + j
                # of a pack with itself each pair comes twice, once in order
                keep = (theme[i] != theme[j]) & ((order[i] < order[j]) if same else (order[i] != order[j]))
                i, j, s = i[keep], j[keep], s[keep]
                turned = order[i] > order[j]
                yield both, np.where(turned, j, i), np.where(turned, i, j), s


def similar_pairs(notes: DataFrame, floor: float = FLOOR, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """(a, b, sim) with a < b by note_id, cosine >= floor, themes different (two notes without a theme don't differ).

    Two packs of notes at a time are multiplied, ``block`` rows of the one by the other, so memory per task is fixed and
    what is shuffled and written is each note once. Only pairs above the floor leave a task.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both, p, q, s in _compared(batches, floor, min(block, STRIP)):
            yield pa.record_batch([both["note_id"].take(pa.array(p)), both["note_id"].take(pa.array(q)), pa.array(s)], ["a", "b", "sim"])

    return _met(_packs(notes, pack)).mapInArrow(join, PAIR).where(F.col("sim") >= floor)


def link_counts(notes: DataFrame, floor: float = FLOOR, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """(note_id, n_links) of ``similar_pairs``: in how many a note comes first; those without any are left out.

    Links are counted where they are found: no pair leaves a task, only a number for each note of its packs, four bytes each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for both, p, _, s in _compared(batches, floor, min(block, STRIP)):
            found = np.bincount(p[s >= floor], minlength=len(both["note_id"]))
            (low, n), (high, _) = both["packs"]
            for k, part in ((low, found[:n]), (high, found[n:])):
                held[k] = held[k] + part if k in held else part
        for k, found in held.items():  # a task has fewer than 2^31 notes
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([found.astype(np.int32).tobytes()], pa.binary())], ["pack", "n"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pack": pdf["pack"].iloc[:1], "n": [sum(np.frombuffer(n, np.int32).astype(np.int64) for n in pdf["n"])]})

    own = _packs(notes, pack)
    sums = _met(own).mapInArrow(count, "pack int, n binary").groupBy("pack").applyInPandas(total, "pack int, n array<long>")
    rows = own.select("pack", "note_id").join(sums, "pack").select(F.explode(F.arrays_zip("note_id", F.col("n").alias("n_links"))).alias("x"))
    return rows.select("x.note_id", "x.n_links").where("n_links > 0")


def heaviest(notes: DataFrame, floor: float, top: int, block: int = BLOCK, rest: DataFrame | None = None, pack: int = PACK) -> DataFrame:
    """(a, b, sim) that hold the ``top`` heaviest links, with ``rest`` those of ``notes`` with each other and with ``rest``, which has none of them.

    Of each task only as many leave it. Weights at the edge of a rounding are kept apart from the others, ``top`` of each weight, so
    that none is lost, whichever way it is rounded later."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pd.DataFrame({"a": NONE, "b": NONE, "sim": [], "w": [], "exact": [], "edge": np.zeros(0, bool)})
        least = -np.inf  # lower weights are beaten by ``top`` others
        for both, p, q, s in _compared(batches, floor, min(block, STRIP), "source", "created_us"):
            source = pd.factorize(both["source"].to_numpy(zero_copy_only=False))[0]
            us = both["created_us"].to_numpy(zero_copy_only=False)  # whole microseconds, exact in doubles
            gap = np.nan_to_num(np.abs(np.floor((us[p] - us[q]) / DAY_US)))
            w = s * (1 + TIME_WEIGHT * np.minimum(gap / 90, 1) + SOURCE_WEIGHT * (source[p] != source[q]))
            whole = np.floor(w * 1e4 + 0.5)
            part = w * 1e4 + 0.5 - whole
            # a weight right at the edge between two roundings may fall to either side; it counts as the greater
            edge = (part > 1 - 1e-6) | (part < 1e-6)
            whole += part > 1 - 1e-6
            some = np.flatnonzero(whole >= least)
            if not len(some):
                continue
            ids = lambda k: both["note_id"].take(pa.array(k[some])).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            fresh = pd.DataFrame({"a": ids(p), "b": ids(q), "sim": s[some], "w": whole[some], "exact": w[some], "edge": edge[some]})
            every = (pd.concat([held, fresh]) if len(held) else fresh).sort_values(["w", "a", "b"], ascending=[False, True, True])
            plain, edge = every[~every["edge"]].head(top), every[every["edge"]]
            if len(plain) == top:  # those of a lower weight are beaten by so many, whichever way they fall
                least = plain["w"].iloc[-1]
                edge = edge[edge["w"] >= least]
            held = pd.concat([plain, edge.groupby("exact").head(top)])  # equal weights fall to the same side, so ids decide among them
        yield pa.record_batch([pa.array(held["a"], pa.string()), pa.array(held["b"], pa.string()), pa.array(held["sim"], pa.float64())], ["a", "b", "sim"])

    own = _packs(notes, pack, "source", "created_us")
    met = _met(own)
    if rest is not None:
        met = met.unionByName(_met(own, _packs(rest, pack, "source", "created_us")))
    return met.mapInArrow(join, PAIR).where(F.col("sim") >= floor)


def weight(sim: Column, gap: Column, other_source: Column) -> Column:
    """Similarity, raised for distance in time (up to 90 days) and for crossing sources."""
    return sim * (1.0 + TIME_WEIGHT * F.least(gap / 90.0, F.lit(1.0)) + SOURCE_WEIGHT * other_source.cast("double"))


def links(notes: DataFrame, floor: float = FLOOR, top: int | None = TOP) -> DataFrame:
    """Links with their weight (4 decimals), best first; ties by ids. ``top=None`` keeps all."""
    out = weighed(similar_pairs(notes, floor) if top is None else heaviest(notes, floor, top), notes)
    return out if top is None else best(out, top)


def weighed(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """Pairs (a, b, sim) as links with their weight."""
    side = lambda p: notes.select(F.col("note_id").alias(p), F.col("theme_id").alias(f"{p}_theme"), F.col("created_us").alias(f"{p}_us"), F.col("source").alias(f"{p}_source"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    gap = F.coalesce(gap_days(F.col("a_us"), F.col("b_us")), F.lit(0))
    return pairs.select(
        link_id(F.col("a"), F.col("b")).alias("link_id"),
        F.col("a").alias("from_note"), F.col("b").alias("to_note"), F.col("a_theme").alias("from_theme"), F.col("b_theme").alias("to_theme"),
        F.round(weight(F.col("sim"), gap, F.col("a_source") != F.col("b_source")), 4).alias("weight"), gap.alias("gap_days"),
    )


def best(rows: DataFrame, top: int) -> DataFrame:
    return rows.orderBy(F.desc("weight"), "from_note", "to_note").limit(top)


def ends(rows: DataFrame) -> DataFrame:
    """(note_id) of both notes of each link."""
    return rows.select(F.explode(F.array("from_note", "to_note")).alias("note_id"))


def with_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Links whose two notes exist, with their texts, sources, sessions and times."""
    side = lambda p: notes.select(F.col("note_id").alias(f"{p}_note"), *[F.col(c).alias(f"{p}_{c}") for c in ("text", "source", "session_id", "created_us")])
    return rows.join(side("from"), "from_note").join(side("to"), "to_note")


def theme_pairs(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Over the best ``top`` links: per unordered pair of themes, how many, the greatest weight, and its link."""
    a, b = F.coalesce("from_theme", F.lit("?")), F.coalesce("to_theme", F.lit("?"))
    best_first = F.struct("weight", F.struct("from_note", "to_note"))
    return (
        best(rows, top)
        .groupBy(F.least(a, b).alias("theme_a"), F.greatest(a, b).alias("theme_b"))
        .agg(F.count("*").alias("n_links"), F.round(F.max("weight"), 3).alias("max_weight"), F.max_by("link_id", best_first).alias("sample_link"))
    )
