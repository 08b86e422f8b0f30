"""SimHash near-dedup with a binary trie self-join.

Fingerprints: 4-word shingles of the lower-cased words, XXH64 (seed 42), a bit is set if it is in over half the hashes.

Links are pairs within 4 differing bits. Such a pair differs in at most 2 bits of the first or of the last 32, so the
trie is traversed twice, once from either end: pairs of nodes go down together, the differing bits add up, and a pair is
dropped once it has more than 2 within the first 32 levels or more than 4 in all. The top levels are dealt out: each
pair of prefixes within 2 bits is a task, and its subtries are traversed there. Fingerprints with many neighbours are
joined up inside a task, which hands on one edge per fingerprint and joined neighbour, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.llm.common import components, free_names, map_batches
from threadlode.session import materialize

BUDGET = 4
HALF = BUDGET // 2
SHINGLE = 4
#: Distinct fingerprints that a prefix holds on average.
PREFIX_ROWS = 16_000
#: Node pairs or leaf pairs expanded at a time.
CHUNK = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is \\x20 and \\x09-\\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, fp, *others): fp as a signed long; a null text counts as empty. ``others`` are columns of longs."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps), *(batch.column(x) for x in others)], ["doc_id", "fp", *others])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others), run, ", ".join(f"{x} long" for x in ("doc_id", "fp", *others)))


def _root(parent: np.ndarray, a: np.ndarray) -> np.ndarray:
    while True:
        b = parent[a]
        if (b == a).all():
            return a
        a = b


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join up all pairs (a, b): roots only ever point to smaller ones."""
    while len(a):
        a, b = _root(parent, a), _root(parent, b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        a, b = low[open_], high[open_]
        np.minimum.at(parent, b, a)
    parent[:] = _root(parent, np.arange(len(parent)))


def trie_links(keys: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Component of each of ``keys`` (sorted, distinct) after joining all pairs within the budgets.

    ``left`` and ``right`` are positions of two subtries below ``depth`` levels; they're the same for a node with itself.
    Subtries are ranges of sorted keys, and a level splits each range at the first key with the level's bit set.
    """
    parent = np.arange(len(keys))
    prefix = int(keys[left[0]] ^ keys[right[0]]) >> (64 - depth) if depth else 0
    stack = [(depth, *(np.array([x], np.int64) for x in (left[0], left[-1] + 1, right[0], right[-1] + 1, prefix.bit_count())))]
    while stack:
        level, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > CHUNK:
            half = len(a0) // 2
            stack += [(level, *(x[:half] for x in (a0, a1, b0, b1, spent))), (level, *(x[half:] for x in (a0, a1, b0, b1, spent)))]
            continue
        small = (a1 - a0) * (b1 - b0) <= 64 if level < 32 else np.ones(len(a0), bool)
        small &= (a1 - a0) * (b1 - b0) <= CHUNK if level < 64 else True
        if small.any():
            _leaves(keys, parent, a0[small], a1[small], b0[small], b1[small])
        live = ~small
        if not live.any() or level == 64:
            continue
        a0, a1, b0, b1, spent = (x[live] for x in (a0, a1, b0, b1, spent))
        bit = np.uint64(1) << np.uint64(63 - level)
        am, bm = _split(keys, a0, a1, bit), _split(keys, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        most = HALF if level < 32 else BUDGET
        kids = [(a0, am, b0, bm, spent, True), (am, a1, bm, b1, spent, True), (a0, am, bm, b1, spent + 1, True), (am, a1, b0, bm, spent + 1, ~same)]
        out = []
        for x0, x1, y0, y1, s, ok in kids:
            ok = (x1 > x0) & (y1 > y0) & (s <= most) & ok
            if ok.any():
                out.append([x[ok] for x in (x0, x1, y0, y1, s)])
        if out:
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*out, strict=True))))
    return parent


def _split(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First position of each range whose key has ``bit`` set (ranges agree on all higher bits)."""
    shift = bit | (bit - np.uint64(1))
    return np.clip(np.searchsorted(keys, (keys[low] & ~shift) | bit), low, high)


def _leaves(keys: np.ndarray, parent: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
    """Compare every key of each left range with every key of its right range, skipping what is joined already."""
    width, size = b1 - b0, (a1 - a0) * (b1 - b0)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        part = slice(at, stop)
        of = np.repeat(np.arange(stop - at), size[part])
        k = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        i, j = a0[part][of] + k // width[part][of], b0[part][of] + k % width[part][of]
        near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= BUDGET)
        i, j = i[near], j[near]
        open_ = parent[i] != parent[j]
        _unite(parent, i[open_], j[open_])
        at = stop


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, component): distinct ``fps(fp)`` linked at 4 or fewer differing bits; component is one of its members."""
    distinct = materialize(fps.select("fp").distinct(), "fingerprints")
    n = distinct.count()
    bits = min(12, max(3, int(np.ceil(np.log2(max(1, n) / PREFIX_ROWS))))) if n > PREFIX_ROWS else 3
    masks = [m for m in range(1 << bits) if m.bit_count() <= HALF]
    # the second traversal starts at the last 32 bits
    turned = F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)")
    both = distinct.select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("key")), F.struct(F.lit(1).alias("turn"), turned.alias("key")))).alias("x")).select("x.*")
    own = both.withColumn("own", F.expr(f"cast(shiftrightunsigned(key, {64 - bits}) as int)"))
    dealt = own.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks]))).withColumn("other", F.expr("own ^ mask"))
    dealt = dealt.select("turn", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        keys = np.sort(pdf["key"].to_numpy().view(np.uint64))
        cut = int(np.searchsorted(keys, np.uint64(high << (64 - bits)))) if low != high else 0
        if low != high and (cut == 0 or cut == len(keys)):
            return pd.DataFrame({"a": [], "b": []})
        every = np.arange(len(keys))
        parent = trie_links(keys, every[:cut] if low != high else every, every[cut:], bits)
        linked = np.flatnonzero(parent != every)
        if pdf["turn"].iloc[0]:
            keys = (keys << np.uint64(32)) | (keys >> np.uint64(32))
        return pd.DataFrame({"a": keys[linked].view(np.int64), "b": keys[parent[linked]].view(np.int64)})

    edges = dealt.groupBy("turn", "low", "high").applyInPandas(join, "a long, b long")
    return components(edges).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links, its own included. A null or blank text has fingerprint
    zero and links like any other. A null doc_id takes part and is never the smallest unless its component has no
    other. Rows that repeat a doc_id are kept. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs), "doc-fingerprints")
    return label_documents(rows)


def _named(rows: DataFrame) -> DataFrame:
    """(fp, group, component_id) of each fingerprint; ``group`` tells components apart that have no doc_id but null."""
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "least-ids")
    joined = materialize(fingerprint_components(rows), "fp-components")
    tops = least.join(joined, "fp").groupBy("component").agg(F.min("least").alias("top"))
    named = materialize(joined.join(tops, "component").select("fp", "component", "top"), "fp-names")
    of = least.join(named, "fp", "left")
    return materialize(of.select("fp", F.coalesce("component", "fp").alias("group"), F.coalesce("top", "least").alias("component_id")), "fp-ids")


def label_documents(rows: DataFrame) -> DataFrame:
    return rows.join(_named(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates: one row a group, that with its smallest
    doc_id; of rows that share it, the one with the least text. All columns of ``docs`` come back as they are, by any name."""
    (row,) = free_names(docs, "_row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-documents")
    own = keyed.select("doc_id", "text", F.col(row).alias("_row"))
    rows = materialize(fingerprints(own, "_row"), "doc-fingerprints")
    named = rows.join(_named(rows), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    tops = materialize(named.groupBy("group").agg(F.count("*").alias("n"), F.min("_row").alias("_row")), "group-tops")
    kept = tops.where("n = 1").select("_row")
    if tops.where("n > 1").limit(1).count():
        tied = named.join(tops.where("n > 1").select("group"), "group").select("group", "_row")
        first = tied.join(own.select("_row", "text"), "_row").groupBy("group").agg(F.min(F.struct("text", "_row")).alias("x"))
        kept = kept.union(first.select("x._row"))
    # a row a document is never broadcast: small tables take the plan of large ones, texts are shuffled once at any size
    return keyed.join(kept.select(F.col("_row").alias(row)).hint("merge"), row, "left_semi").select(*docs.columns)
