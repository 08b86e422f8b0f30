"""What several operators share: bounded Arrow batches, numbers in an order, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlode.session import materialize

#: For bytes.translate: A-Z as a-z, and every other byte of ASCII that is no letter or digit as a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of one text that are split into words at a time.
WORDS_AT_ONCE = 1 << 20

#: Text that one call of a worker's function holds at a time.
BATCH_BYTES = 6 << 20


def bounded(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(n, int(n * most / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over batches of about ``most`` bytes."""

    def run(batches):
        yield from f(bounded(batches, most))

    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that are none of the columns of ``df``, whatever their case: ``wanted``, lengthened where taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_runs(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, in order, some at a time: runs of digits, letters A-Z in lower case, and characters beyond ASCII."""
    data, at = (text or b"").translate(WORD_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + WORDS_AT_ONCE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def numbered(df: DataFrame, order: list[str], groups: list[str], name: str) -> DataFrame:
    """``df`` with ``number``: each row's place from 0 in ``order``, within ``groups``, which lead the order. Partitions are
    ranges, so a group may span many; only counts by partition and group meet."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialize(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), name)
    runs = kept.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = runs.select(*groups, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return kept.join(bases, [*groups, "_part"]).withColumn("number", F.expr("_base + _at - _first")).drop("_part", "_at", "_base", "_first")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, component) with the smallest node reachable.

    Every round takes each node to the smallest label next to it, lets that label's old root follow, and then halves
    the paths. All joins are plain equi-joins of written tables, so that Spark can split a hot key; minima are
    partly aggregated before they are shuffled. Nothing but one count per round reaches the driver.
    Nodes without edges are not returned; an edge with a null end is dropped. Paths halve each round, so rounds grow with
    the logarithm of the nodes; should ``most_rounds`` not do, an error is raised and no unfinished label returned.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = materialize(labels.join(near, "node").select("node", "component", F.least("component", "near").alias("near")), "met")
        hooks = met.where("near < component").groupBy(F.col("component").alias("node")).agg(F.min("near").alias("hook"))
        hooked = materialize(met.join(hooks, "node", "left").select("node", F.least("near", "hook").alias("component"), (F.col("near") < F.col("component")).alias("moved")), "hooked")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = materialize(hooked.join(jump, "component").select("node", F.col("root").alias("component"), (F.col("moved") | (F.col("root") < F.col("component"))).alias("moved")), "labels")
        if labels.where("moved").limit(1).count() == 0:
            break
        labels = labels.drop("moved")
    else:
        raise RuntimeError(f"components unfinished after {most_rounds} rounds")
    return labels.select("node", "component")
