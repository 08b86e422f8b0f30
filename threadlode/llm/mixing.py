"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are dealt into blocks in hashed order. A source with ``parts`` out of P gets, for its k-th
block of a phase, the release slot floor(k * P / parts) and the deadline ceil((k + 1) * P / parts); the slots go to the
released block with the earliest deadline. For one resource and full load this meets all deadlines, so in every prefix
each source is less than one block away from its weight. The schedule repeats after P slots, so only P slots are ever
computed, however many blocks there are. When a source has no blocks left, its phase ends and the next one begins with
the others' parts: every document is placed exactly once and none is repeated or dropped.

Up to ``MOST_ALONE + SHARED`` sources are scheduled side by side. With more, the ``MOST_ALONE`` largest keep classes of
their own, and all others are dealt into ``SHARED`` classes by hash: a class has its sources' weights and blocks together,
and its own blocks go to its sources by a further Pfair schedule, made on an executor. So every source has its weight at
any number of sources; one in a shared class is less than a block away from its share of the class, and the class less
than a block from its weight, so that it may be up to two blocks away in all. A class's schedule takes time in proportion
to the square of its sources: some 1,000 of them (130,000 sources in all) take seconds.

Only classes reach the driver, at most ``MOST_ALONE + SHARED``. Of the schedule a task is sent arrays: for each phase
(one ends with each class) the slots of one period, and how many blocks each class has had before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.llm.common import free_names, numbered
from threadlode.session import materialize

#: Parts that temperature weights are rounded to: the length of a period.
PARTS = 1024
BLOCK_DOCS = 64
MOST_ALONE, SHARED = 128, 127


def pfair(parts: dict[str, int]) -> list[str]:
    """One period: the source of each of its sum(parts) slots."""
    total = sum(parts.values())
    waiting = sorted((0, -(-total // p), s, 0) for s, p in parts.items())
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, k))
        deadline, s, k = heapq.heappop(ready)
        assert slot < deadline
        out.append(s)
        if (k := k + 1) < parts[s]:
            heapq.heappush(waiting, (k * total // parts[s], -(-(k + 1) * total // parts[s]), s, k))
    return out


def rounded_parts(raw: dict[str, float], parts: int = PARTS) -> dict[str, int]:
    """Parts in proportion to ``raw``, at least one each, by largest remainders."""
    size = max(parts, 4 * len(raw))
    scale = (size - len(raw)) / sum(raw.values())
    out = {s: 1 + int(x * scale) for s, x in raw.items()}
    for s in sorted(raw, key=lambda s: (-(raw[s] * scale % 1), s))[: size - sum(out.values())]:
        out[s] += 1
    return out


class Schedule:
    """Slots of the blocks of each source: ``slots(source, blocks)``; all phases until every block has one."""

    def __init__(self, parts: dict[str, int], blocks: dict[str, int]):
        self.number = {s: k for k, s in enumerate(sorted(blocks))}
        left, base = dict(blocks), 0
        self.phases: list[tuple] = []  # first slot, period, slots in the period by source, where each source's begin
        had = [np.zeros(len(blocks), np.int64)]  # blocks that each source had before each phase
        while left := {s: n for s, n in left.items() if n}:
            unit = gcd(*(parts[s] for s in left))
            own = {s: parts[s] // unit for s in left}
            period = np.array([self.number[s] for s in pfair(own)])
            order = np.argsort(period, kind="stable").astype(np.int32)
            ends = np.searchsorted(period[order], np.arange(len(blocks) + 1)).astype(np.int32)
            at = {s: order[ends[self.number[s]] : ends[self.number[s] + 1]] for s in left}
            # the phase ends after the slot with the last block of the source that ends first
            end = min((n - 1) // own[s] * len(period) + int(at[s][(n - 1) % own[s]]) + 1 for s, n in left.items())
            full, rest = divmod(end, len(period))
            used = np.zeros(len(blocks), np.int64)
            for s in left:
                used[self.number[s]] = full * own[s] + int((at[s] < rest).sum())
                left[s] -= int(used[self.number[s]])
            self.phases.append((base, len(period), order, ends))
            had.append(had[-1] + used)
            base += end
        self.had = np.array(had)

    def slots(self, source: str, block: np.ndarray) -> np.ndarray:
        k = self.number[source]
        phase = np.searchsorted(self.had[:, k], block, "right") - 1
        out = np.empty(len(block), np.int64)
        for p in np.unique(phase):
            base, period, order, ends = self.phases[p]
            mine = order[ends[k] : ends[k + 1]]
            here = phase == p
            turn, at = np.divmod(block[here] - self.had[p, k], len(mine))
            out[here] = base + turn * period + mine[at]
        return out


def _classes(sizes: DataFrame, alone: int, shared: int, seed: int) -> DataFrame:
    """``sizes(source_key, n, raw)`` with the class of each source."""
    if sizes.count() <= alone + shared:
        return sizes.withColumn("class", F.col("source_key"))
    top = [r["source_key"] for r in sizes.orderBy(F.desc("n"), "source_key").limit(alone).collect()]
    dealt = F.concat(F.lit("shared:"), F.pmod(F.xxhash64(F.lit(seed), "source_key"), F.lit(shared)).cast("string"))
    return sizes.withColumn("class", F.when(F.col("source_key").isin(top), F.col("source_key")).otherwise(dealt))


def _whole(raw: dict[str, float], exact: bool) -> dict[str, int]:
    return {s: int(x) for s, x in raw.items()} if exact else rounded_parts(raw)


def mix(docs: DataFrame, weights: dict[str, int] | None = None, power: float = 0.7, block_docs: int = BLOCK_DOCS, most_alone: int = MOST_ALONE, shared: int = SHARED, seed: int = 42) -> DataFrame:
    """One row per row of ``docs(doc_id, source)``: doc_id, source, block (of its source), slot, position.

    ``weights``: parts by source; sources it doesn't name share the class ``other`` with one part, or with the part
    named so. Without it, parts follow counts ** power. A null source is a source of its own, written as null. Rows
    that repeat a doc_id are placed each. A null doc_id is placed like any other. An empty table gives no rows.
    Positions run from 0 without gaps; slots are blocks in their final order.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("source:"), "source"))
    rows = docs.select("doc_id", "source", key.alias("source_key"))
    if weights is not None:
        given = {"other": float(weights.get("other", 1))} | {f"source:{s}": float(p) for s, p in weights.items() if s != "other" and p > 0}
        named = spark.createDataFrame([*given.items()], "source_key string, raw double")
        rows = rows.join(named.where("source_key <> 'other'").select("source_key", F.lit(True).alias("_named")), "source_key", "left")
        rows = rows.withColumn("source_key", F.when(F.col("_named"), F.col("source_key")).otherwise("other")).drop("_named")
    keyed = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("row", F.monotonically_increasing_id())
    ranked = numbered(keyed, ["source_key", "h", "doc_id", "row"], ["source_key"], "mix-order").drop("h", "row")
    ranked = ranked.withColumn("block", F.expr(f"number div {block_docs}")).withColumn("rank", F.expr(f"number % {block_docs}")).drop("number")
    counts = rows.groupBy("source_key").agg(F.count("*").alias("n"))
    sizes = counts.withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(power))) if weights is None else counts.join(named, "source_key")
    sources = materialize(_classes(sizes, most_alone, shared, seed).withColumn("blocks", F.expr(f"(n + {block_docs - 1}) div {block_docs}")), "mix-sources")
    classes = sources.groupBy("class").agg(F.sum("blocks").alias("blocks"), F.sum("raw").alias("raw"), F.count("*").alias("members")).collect()  # at most most_alone + shared rows
    if not classes:
        return spark.createDataFrame([], "doc_id long, source string, block long, slot long, position long")
    plan = Schedule(_whole({r["class"]: r["raw"] for r in classes}, weights is not None), {r["class"]: r["blocks"] for r in classes})
    many = any(r["members"] > 1 for r in classes)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        """The class's block for each block of its sources."""
        own = Schedule(_whole(dict(zip(pdf["source_key"], pdf["raw"], strict=True)), weights is not None), dict(zip(pdf["source_key"], pdf["blocks"].tolist(), strict=True)))
        every = [(s, np.arange(n)) for s, n in zip(pdf["source_key"], pdf["blocks"].tolist(), strict=True)]
        parts = [pd.DataFrame({"class": pdf["class"].iloc[0], "source_key": s, "block": b, "class_block": own.slots(s, b)}) for s, b in every]
        return pd.concat(parts)

    if many:
        of = sources.join(sources.groupBy("class").agg(F.count("*").alias("members")).where("members > 1").select("class"), "class", "left_semi")
        told = of.groupBy("class").applyInPandas(within, "class string, source_key string, block long, class_block long")  # a row a block
        ranked = ranked.join(told, ["source_key", "block"], "left").withColumn("class", F.coalesce("class", "source_key")).withColumn("class_block", F.coalesce("class_block", "block"))
    else:
        ranked = ranked.withColumn("class", F.col("source_key")).withColumn("class_block", F.col("block"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("class").dictionary_encode()
            which, block = coded.indices.to_numpy(zero_copy_only=False), batch.column("class_block").to_numpy(zero_copy_only=False)
            slot = np.empty(len(block), np.int64)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                slot[which == k] = plan.slots(name, block[which == k])
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), batch.column("block"), pa.array(slot), batch.column("rank")], ["doc_id", "source", "block", "slot", "rank"])

    placed = ranked.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "block", "rank", "class", "class_block").mapInArrow(place, "doc_id long, source string, block long, slot long, rank long")
    return numbered(placed, ["slot", "rank"], [], "mix-positions").select("doc_id", "source", "block", "slot", F.col("number").alias("position"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs``, every row once, dealt over files and ordered within them by position in the mix: what is written has its rows in this order,
    by file name and place in the file.

    Rows with the same doc_id and source stay together at the first of their positions. All columns of ``docs`` come back as they are, by any name.
    """
    d, s, position = free_names(docs, "_d", "_s", "_position")
    place = mix(docs, **options).groupBy(F.col("doc_id").alias(d), F.col("source").alias(s)).agg(F.min("position").alias(position))
    # a row a document is never broadcast: small tables take the plan of large ones, texts are shuffled twice at any size
    placed = docs.join(place.hint("merge"), docs["doc_id"].eqNullSafe(F.col(d)) & docs["source"].eqNullSafe(F.col(s)))
    return placed.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)
