"""Document fingerprints by consistent weighted sampling. DataFrame functions only; no Python on the executors.

A document is a bag of words, each weighted by how often it occurs. For sample j, a word of weight S has three variates that
depend on the word and j alone: r and c, both Gamma(2, 1), and b, uniform in (0, 1). With t = floor(ln S / r + b) and
ln y = r (t - b), the word with the least a = c / (y e^r) is chosen, and the sample is that word with its t. Two bags choose the same sample
with a probability of sum(min) / sum(max) over their weights, which is generalised Jaccard similarity; so the share of equal samples,
out of ``SAMPLES``, estimates it with a standard error of at most 0.5 / sqrt(SAMPLES). A sample is kept as 16 bits of a hash: unlike samples
look alike once in 65,536 times.

Nothing here depends on how rows are dealt out. Texts are shuffled once, to where their key is, and the part of the next document
that an edited text takes once more; words are counted and sampled where the text lies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlode.llm.common import numbered
from threadlode.session import materialize

SAMPLES = 32
#: Samples computed side by side: so many that the JVM still compiles the generated method.
SIDE = 2
#: Hex digits of a sample.
DIGITS = 4
#: What a text without words has in place of its samples.
NO_WORDS = "0" * (SAMPLES * DIGITS)
KEY = ["d", "n", "h"]


def words(text: Column) -> Column:
    """Runs of letters, marks and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _small(x: Column) -> Column:
    """The 64th root: square roots are machine instructions, unlike logarithms."""
    for _ in range(6):
        x = F.sqrt(x)
    return x


def _log(s: Column, q: Column) -> Column:
    """ln x for s = (root - 1) / (root + 1) of x's 64th root and q = s * s, to 1e-5 for x in (2^-42, 64)."""
    return s * (q * (q * (q * (128 / 7) + 128 / 5) + 128 / 3) + 128)


def samples(counts: DataFrame, keys: list[str], weights: list[str], n_samples: int = SAMPLES) -> DataFrame:
    """The samples of the bags ``counts(*keys, term, *weights)``: a row per key, and for each column of weights a string of
    ``DIGITS`` hex digits a sample, in a column of the same name; null where a bag holds nothing.

    ``term`` is a long, a hash of the word; each column of weights is a bag of its own over the same words, and a weight of zero or null means that the
    word isn't in it. A (key, term) must not repeat. If ``counts`` is dealt by some of ``keys``, nothing is shuffled.

    The JVM's strict logarithms cost more than all the rest, so Gamma(2, 1), -ln(u v) for uniform u and v, and its logarithm are made of square roots and a
    short series. They are right to 1e-5, and the same wherever they are computed.
    """
    side = range(SIDE)
    each = lambda *named: [f(j).alias(f"{name}{j}") for name, f in named for j in side]
    x, y, b, r, c, p, q = (lambda j, name=name: F.col(f"{name}{j}") for name in "xybrcpq")
    uniform = lambda bits, shift: F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") * 2.0**-21 + 2.0**-22
    logs = [F.when(F.col(name) > 1, F.coalesce(F.log(F.col(name).cast("double")), F.lit(0.0))).when(F.col(name) > 0, 0.0).otherwise(-1.0).alias(f"ln_{name}") for name in weights]
    held = [*keys, "block", *[f"ln_{name}" for name in weights]]
    rows = counts.select(*keys, F.coalesce("term", F.lit(0)).alias("term"), *logs)
    rows = rows.select("*", F.explode(F.array(*[F.lit(b) for b in range(0, n_samples, SIDE)])).alias("block"))
    rows = rows.select(*held, *each(("x", lambda j: F.xxhash64("term", F.col("block") + j))))
    rows = rows.select(*held, *each(("x", x), ("y", lambda j: F.xxhash64(x(j)))))
    rows = rows.select(*held, *each(("x", x), ("b", lambda j: uniform(x(j), 42)), ("r", lambda j: _small(uniform(x(j), 0) * uniform(x(j), 21))), ("c", lambda j: _small(uniform(y(j), 0) * uniform(y(j), 21)))))
    rows = rows.select(*held, *each(("x", x), ("b", b), ("r", lambda j: (1 - r(j)) / (1 + r(j))), ("c", lambda j: (1 - c(j)) / (1 + c(j)))))
    rows = rows.select(*held, *each(("x", x), ("b", b), ("r", r), ("c", c), ("p", lambda j: r(j) * r(j)), ("q", lambda j: c(j) * c(j))))
    rows = rows.select(*held, *each(("x", x), ("b", b), ("r", lambda j: _log(r(j), p(j))), ("c", lambda j: _small(_log(c(j), q(j))))))
    rows = rows.select(*held, *each(("x", x), ("b", b), ("r", r), ("c", lambda j: (c(j) - 1) / (c(j) + 1))))
    rows = rows.select(*held, *each(("x", x), ("b", b), ("r", r), ("c", c), ("q", lambda j: c(j) * c(j))))
    rows = rows.select(*held, *each(("x", x), ("b", b), ("r", r), ("c", lambda j: _log(c(j), q(j)))))
    rows = rows.select("*", *[F.floor(F.col(f"ln_{name}") / r(j) + F.col(f"b{j}")).alias(f"t_{name}{j}") for name in weights for j in side])
    # ln a is between -80 and 4; its first 31 bits lead, and the sample's hash follows, so that the least of them is the sample chosen
    drawn = lambda name, j: (
        F.shiftleft(F.floor((c(j) + 80 - r(j) * (F.col(f"t_{name}{j}") - F.col(f"b{j}") + 1)) * (1 << 24)), 32).bitwiseOR(F.xxhash64(x(j), f"t_{name}{j}").bitwiseAND(F.lit((1 << 32) - 1)))
    )
    nothing = F.lit((1 << 63) - 1)
    blocks = rows.groupBy(*keys, "block").agg(*[F.min(F.when(F.col(f"ln_{name}") < 0, nothing).otherwise(drawn(name, j))).alias(f"{name}{j}") for name in weights for j in side])
    digits = [F.concat(*[F.lpad(F.hex(F.col(f"{name}{j}").bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))), DIGITS, "0") for j in side]) for name in weights]
    digits = [F.when(F.col(f"{name}0") < nothing, d).alias(name) for name, d in zip(weights, digits, strict=True)]
    parts = F.array_sort(F.collect_list(F.struct("block", *weights)))
    whole = blocks.select(*keys, "block", *digits).groupBy(*keys).agg(parts.alias("parts"))
    # a bag without words is null in all blocks; nulls are left out by array_join
    return whole.select(*keys, *[F.nullif(F.lower(F.array_join(F.col(f"parts.{name}"), "")), F.lit("")).alias(name) for name in weights])


def likeness(a: Column, b: Column, n_samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    same = F.filter(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda k: F.substr(a, k * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, k * DIGITS + 1, F.lit(DIGITS)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(same) / F.lit(float(n_samples)))


def _in_order(texts: DataFrame) -> DataFrame:
    """(d, n, h, doc_id, copies, next_d, next_n, next_h): every distinct row and the one after it by descending doc_id; null ids last, and rows of the
    same doc_id by length and hash. After the last comes the first."""
    meta = texts.groupBy(*KEY).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    meta = meta.withColumn("nameless", F.col("doc_id").isNull()).withColumn("down", F.bitwise_not("d"))
    placed = materialize(numbered(meta, ["nameless", "down", "n", "h"], [], "fingerprint-order"), "fingerprint-numbers")
    after = F.when(F.col("number") == placed.count() - 1, F.lit(0)).otherwise(F.col("number") + 1)
    following = placed.select("number", *[F.col(k).alias(f"next_{k}") for k in KEY])
    return materialize(placed.select(*KEY, "doc_id", "copies", after.alias("number")).join(following, "number").drop("number"), "fingerprint-pairs")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document by descending
    doc_id. A null text counts as empty; a text without words has a fingerprint of zeros, which is like another such and unlike all others. Null doc_ids come
    last; of rows that share a doc_id the shorter comes first, and rows that are wholly equal follow each other, each with the next copy as
    its next document. A single document is its own next one. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.length("text").alias("n"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "doc_id", "text")
    pairs = _in_order(rows.select(*KEY, "doc_id"))
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"))  # wholly equal rows once
    asked = pairs.select(*[F.col(f"next_{k}").alias(k) for k in KEY], *[F.col(k).alias(f"for_{k}") for k in KEY])
    given = texts.join(asked, KEY).select(*[F.col(f"for_{k}").alias(k) for k in KEY], F.expr("substr(text, 1, for_n div 2)").alias("given"))
    both = texts.join(given, KEY).join(pairs.select(*KEY, "copies"), KEY)
    kept = F.expr("substr(text, 1, n - n div 2)")
    last = F.struct(F.lit(False).alias("copy"), F.concat(kept, "given").alias("edited"))
    earlier = F.struct(F.lit(True).alias("copy"), F.concat(kept, F.expr("substr(text, 1, n div 2)")).alias("edited"))  # followed by a copy of itself
    edits = both.select(*KEY, "text", F.explode(F.when(F.col("copies") > 1, F.array(last, earlier)).otherwise(F.array(last))).alias("x")).select(*KEY, "text", "x.copy", "x.edited")
    key = [*KEY, "copy"]
    two = F.array(F.struct(F.lit(0).alias("edited"), F.col("text").alias("text")), F.struct(F.lit(1).alias("edited"), F.col("edited").alias("text")))
    each = edits.select(*key, F.explode(two).alias("x")).select(*key, "x.edited", F.explode(words(F.col("x.text"))).alias("word"))
    counts = each.select(*key, F.xxhash64("word").alias("term"), "edited").groupBy(*key, "term").agg(F.sum(1 - F.col("edited")).alias("own"), F.sum("edited").alias("changed"))
    drawn = samples(counts, key, ["own", "changed"])
    named = edits.select(*key, F.sha2("edited", 256).alias("edited_sha256")).join(drawn, key, "left")
    named = named.select(*key, "edited_sha256", F.coalesce("own", F.lit(NO_WORDS)).alias("fingerprint"), F.coalesce("changed", F.lit(NO_WORDS)).alias("edited_fingerprint"))
    written = materialize(named, "fingerprints")
    following = written.where("not copy").select(*[F.col(k).alias(f"next_{k}") for k in KEY], F.col("fingerprint").alias("next_fingerprint"))
    told = written.join(pairs, KEY).join(following, [f"next_{k}" for k in KEY])
    near_next = F.when(F.col("copy"), F.lit(1.0)).otherwise(likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    told = told.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), near_next.alias("near_next"),
        F.when(F.col("copy"), F.col("copies") - 1).otherwise(F.lit(1)).alias("times"),
    )
    alone = told.where("times = 1").drop("times")
    thousands = told.where("times > 1").withColumn("some", F.explode(F.sequence(F.lit(0), F.expr("(times - 1) div 1000")))).hint("rebalance")
    copies = thousands.withColumn("one", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("times") - F.col("some") * 1000)))).drop("times", "some", "one")
    return alone.union(copies)
