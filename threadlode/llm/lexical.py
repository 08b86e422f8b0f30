"""Ranked lexical search: for each item the documents with the highest BM25-like integer scores, exactly.

The index holds a row per document: its length and, of the terms that items ask for, numbers and counts. From it the highest impacts
of every term are kept, ``k`` of them. The least of these, with the term's weight, is reached by k documents, so an item's kth score is at least the
largest such value over its terms: the floor that seeds the search. The terms of an item are put in the order of what they can add at most;
those at the weak end that can't reach the floor together are pruned (a document that holds no other term is no candidate), and a candidate whose other
terms and all pruned ones together stay below the floor is dropped. What is left is scored exactly over all terms of the item.

Floors rise as a task finds better documents, which prunes more, and a task hands on its own ``k`` best of each item: the best of all are among them, as
a document that k others beat in its task is beaten by them everywhere. So no posting list travels, and no frequent word meets in one place.

Items are asked in blocks of bounded size; a block's terms, at most ``BLOCK_TERMS`` and one item's more, are what is sent to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlode.llm.common import map_batches, word_runs
from threadlode.session import materialize

TOP = 20
#: An item closes its block when the block has so many distinct terms, or items.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 17, 1 << 11
#: Sums by document and item that are held at a time.
CELLS = 1 << 20
#: Tops of a term, and of an item, meet in so many parts first.
PARTS = 64


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, terms, counts): the distinct terms of each text, and how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                seen: dict[bytes, int] = {}
                for words in word_runs(text):
                    for w in words:
                        seen[w] = seen.get(w, 0) + 1
                found.append(seen)
            columns = [batch.column(key), pa.array([[w.decode() for w in f] for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.record_batch(columns, [key, "terms", "counts"])

    return map_batches(rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")), run, f"{key} long, terms array<string>, counts array<long>")


def index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: its terms in all, and the numbers and counts of those in ``terms``, as
    32-bit and 64-bit numbers end to end."""
    number = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, which, counts = [], [], [], []
            for at, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                n, own = 0, []
                for words in word_runs(text):
                    n += len(words)
                    own.append(np.array([k for k in map(number.get, words) if k is not None], np.int32))
                if n:
                    ids, tf = np.unique(np.concatenate(own), return_counts=True)
                    kept.append(at)
                    sizes.append(n)
                    which.append(ids.astype(np.int32).tobytes())
                    counts.append(tf.astype(np.int64).tobytes())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(which, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, terms binary, counts binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a batch of the index: row, term, count, and each row's number of terms."""
    terms = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("terms")]
    counts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("counts")]
    row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    return row, np.concatenate([np.zeros(0, np.int32), *terms]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *counts]), batch.column("n").to_numpy(zero_copy_only=False)


def impact(count: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds for each unit of its weight: up to 10^6, more for more occurrences, less in longer documents."""
    return (1_000_000_000 * count) // (1000 * count + 12 * (75 + 25 * n * n_docs // n_terms))


def _best(key: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` greatest values of each key, the greatest first, ties to the smaller ``tie``."""
    order = np.lexsort((tie, -value, key))
    sorted_key = key[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_key, sorted_key) < k]


def _top_rows(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first ``k`` of each key; each key's rows are cut in ``PARTS`` parts first, so that none meets all at once."""
    parts = Window.partitionBy(key, "part").orderBy(*order)
    every = Window.partitionBy(key).orderBy(*order)
    some = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k).drop("rank", "part")
    return some.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)


def top_impacts(indexed: DataFrame, n_docs: int, n_terms: int, n_words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of ``n_words`` terms: in how many documents it is, its kth highest impact (0 if fewer have it), and its highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, holding, df = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_words, np.int64)
        for batch in batches:
            row, term, count, n = _flat(batch)
            df += np.bincount(term, minlength=n_words)
            key, value = np.concatenate([holding, term]), np.concatenate([held, impact(count, n[row], n_docs, n_terms)])
            keep = _best(key, value, value, k)
            holding, held = key[keep], value[keep]
        some = np.flatnonzero(df)
        whole = [np.concatenate([holding, some]), np.concatenate([held, np.zeros(len(some), np.int64)]), np.concatenate([np.zeros(len(holding), np.int64), df[some]])]
        yield pa.record_batch([pa.array(x) for x in whole], ["term", "impact", "df"])

    rows = materialize(map_batches(indexed, run, "term long, impact long, df long"), "impacts")
    best = _top_rows(rows.where("df = 0"), "term", [F.desc("impact")], k).groupBy("term").agg(F.max("impact").alias("most"), F.min("impact").alias("kth"), F.count("*").alias("held"))
    df, kth, most = (np.zeros(n_words, np.int64) for _ in range(3))
    for r in rows.where("df > 0").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # a row a term of the block
        df[r["term"]] = r["df"]
    for r in best.toLocalIterator():
        most[r["term"]], kth[r["term"]] = r["most"], r["kth"] if r["held"] == k else 0
    return df, kth, most


class Asked:
    """A block's items over its numbered terms, the weakest term of each item first; ``floor`` is a lower bound of each item's kth score."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, kth: np.ndarray, most: np.ndarray):
        self.size = np.array([len(t) for t, _ in items], np.int64)
        self.start = np.cumsum(self.size) - self.size
        item = np.repeat(np.arange(len(items)), self.size)
        term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in items]])
        factor = np.concatenate([np.zeros(0, np.int64), *[m for _, m in items]]) * weight[term]
        order = np.lexsort((term, factor * most[term], item))
        self.item, self.term, self.factor = item, term[order], factor[order]
        self.most = self.factor * most[self.term]
        self.floor = np.zeros(len(items), np.int64)
        np.maximum.at(self.floor, item, self.factor * kth[self.term])
        sums = np.cumsum(self.most)
        first = np.concatenate([[0], sums])[self.start]
        self.upto = sums - first[item]  # what a term and all weaker ones of its item can add
        self.prune()

    def prune(self) -> None:
        """By the present floors: which pairs of term and item give candidates, and what the others can add."""
        weak = self.upto < self.floor[self.item]
        self.weak = np.zeros(len(self.floor), np.int64)
        np.add.at(self.weak, self.item[weak], self.most[weak])
        live = np.flatnonzero(~weak)
        live = live[np.argsort(self.term[live], kind="stable")]
        self.live_term, self.live_item, self.live_factor = self.term[live], self.item[live], self.factor[live]


def search(indexed: DataFrame, asked: Asked, n_docs: int, n_terms: int, n_words: int, k: int) -> DataFrame:
    """(item, doc_id, score): ``k`` best documents of each item in each task, all that reach its floor."""
    n_items = len(asked.floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, doc, score, nameless = (np.zeros(0, np.int64) for _ in range(4))
        step = max(1, CELLS // max(1, n_items))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, term, count, n = _flat(batch)
                gain = impact(count, n[row], n_docs, n_terms)
                low, high = np.searchsorted(asked.live_term, term), np.searchsorted(asked.live_term, term, "right")
                reach = high - low
                of = np.repeat(np.arange(len(row)), reach)
                pair = np.arange(len(of)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(low, reach)
                cells = np.zeros(batch.num_rows * n_items, np.int64)
                np.add.at(cells, row[of] * n_items + asked.live_item[pair], gain[of] * asked.live_factor[pair])
                found = np.flatnonzero(cells)
                found = found[cells[found] + asked.weak[found % n_items] >= asked.floor[found % n_items]]
                d, i = np.divmod(found, n_items)
                points = _exact(asked, d, i, row * n_words + term, gain, n_words)
                good = (points >= asked.floor[i]) & (points > 0)
                d, i, points = d[good], i[good], points[good]
                ids = batch.column("doc_id")
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
                item, doc, score, nameless = (np.concatenate(x) for x in ((item, i), (doc, numbers[d]), (score, points), (nameless, none[d])))
                place = np.lexsort((doc, nameless, -score, item))
                place = place[np.arange(len(place)) - np.searchsorted(item[place], item[place]) < k]
                item, doc, score, nameless = item[place], doc[place], score[place], nameless[place]
                held = np.bincount(item, minlength=n_items)
                full = np.flatnonzero(held >= k)
                if len(full):
                    last = (np.cumsum(held) - 1)[full]
                    better = score[last] > asked.floor[full]
                    if better.any():
                        asked.floor[full[better]] = score[last][better]
                        asked.prune()
        yield pa.record_batch([pa.array(item), pa.array(doc, mask=nameless.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return map_batches(indexed, run, "item long, doc_id long, score long")


def _exact(asked: Asked, d: np.ndarray, i: np.ndarray, postings: np.ndarray, gain: np.ndarray, n_words: int) -> np.ndarray:
    """The score of each candidate over all terms of its item; ``postings`` are sorted numbers of row and term."""
    points = np.zeros(len(d), np.int64)
    if not len(postings):
        return points
    ends = np.cumsum(asked.size[i])
    at = 0
    while at < len(d):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        size = asked.size[i[at:stop]]
        of = np.repeat(np.arange(at, stop), size)
        pair = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(asked.start[i[at:stop]], size)
        wanted = d[of] * n_words + asked.term[pair]
        place = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
        hit = postings[place] == wanted
        np.add.at(points, of[hit], gain[place[hit]] * asked.factor[pair[hit]])
        at = stop
    return points


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str], list[int]]]]:
    """Items with a term, in blocks."""
    block, terms = [], set()
    for r in items.toLocalIterator():
        if r["terms"]:
            block.append((r["item_id"], r["terms"], r["counts"]))
            terms.update(r["terms"])
            if len(terms) >= BLOCK_TERMS or len(block) >= BLOCK_ITEMS:
                yield block
                block, terms = [], set()
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of ``items(item_id, text)`` the ``k`` rows of ``docs(doc_id, text)`` with the highest scores above 0.

    Equal scores are put in the order of doc_id, null last; rows that repeat a doc_id are documents each, rows that repeat an item_id are asked each,
    with ranks of their own. A null or empty text has no term: such an item gets no rows, such a document counts nowhere. Empty tables give no rows; other
    columns are ignored. Texts are split a megabyte at a time; an item's distinct terms and a document's terms that are asked for must fit a task.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(materialize(term_counts(items, "item_id"), "items")):
        words = sorted({t for _, terms, _ in block for t in terms})
        number = {t: j for j, t in enumerate(words)}
        indexed = materialize(index(docs, [t.encode() for t in words]), "index")
        total = indexed.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            break
        counts = total["docs"], total["terms"], len(words), k
        df, kth, most = top_impacts(indexed, *counts)
        weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        asked = Asked([(np.array([number[t] for t in terms], np.int64), np.array(times, np.int64)) for _, terms, times in block], weight, kth, most)
        found = materialize(search(indexed, asked, *counts), "found")
        ids = spark.createDataFrame([(j, item) for j, (item, _, _) in enumerate(block)], "item long, item_id long")
        best = _top_rows(found, "item", [F.desc("score"), F.asc_nulls_last("doc_id")], k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # ids: a row an item of the block
        out = best if out is None else out.union(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
