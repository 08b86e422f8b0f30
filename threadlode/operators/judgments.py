"""What the user decided: ratings, mutes and digests. These tables are only ever added to or updated by a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlode.functions.text import strip
from threadlode.operators.store import latest


def rate(proposals: DataFrame, ratings: DataFrame) -> DataFrame:
    """``proposals`` with outcome, rating_note, rated_us and rated_via of the last of ``ratings(proposal_id, outcome, note,
    via, rated_us)`` for each; ratings of unknown proposals do nothing."""
    last = latest(ratings, ["proposal_id"], [F.desc("rated_us"), F.desc("outcome"), F.desc("via")])
    last = last.select("proposal_id", F.col("outcome").alias("_o"), F.col("note").alias("rating_note"), "rated_us", F.col("via").alias("rated_via"))
    rest = [c for c in proposals.columns if c not in ("outcome", "rating_note", "rated_us", "rated_via")]
    rated = proposals.select(*rest, "outcome").join(last, "proposal_id", "left")
    return rated.select(*rest, F.coalesce("_o", "outcome").alias("outcome"), "rating_note", "rated_us", "rated_via")


def muted_form(label: Column) -> Column:
    return F.lower(strip(label))


def mute(muted: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_lc) with the labels of ``labels(label)``, each once."""
    return muted.select("label_lc").union(labels.select(muted_form(F.col("label")))).distinct()


def unmute(muted: DataFrame, labels: DataFrame) -> DataFrame:
    return muted.select("label_lc").join(labels.select(muted_form(F.col("label")).alias("label_lc")), "label_lc", "left_anti")


def insert_digest(digests: DataFrame, items: DataFrame, new: DataFrame, created_us: int) -> tuple[DataFrame, DataFrame]:
    """The tables digests (digest_id, created_us, item_count) and items (digest_id, n, kind, ref, theme_ref, snapshot,
    outcome) with a further digest of the items ``new``, numbered on; a digest without items is recorded too."""
    following = digests.agg((F.coalesce(F.max("digest_id"), F.lit(0)) + 1).alias("digest_id"))
    own = new.join(F.broadcast(following))  # one row
    row = following.join(F.broadcast(new.agg(F.count("*").alias("item_count")))).select("digest_id", F.lit(created_us).alias("created_us"), "item_count")  # one row each
    return digests.select("digest_id", "created_us", "item_count").union(row), items.unionByName(own.select(*items.columns))


def set_outcomes(items: DataFrame, acts: DataFrame) -> DataFrame:
    """``items`` with the outcome and acted_us of the last of ``acts(digest_id, n, outcome, acted_us)`` for each."""
    last = latest(acts, ["digest_id", "n"], [F.desc("acted_us"), F.desc("outcome")]).select("digest_id", "n", F.col("outcome").alias("_o"), "acted_us")
    rest = [c for c in items.columns if c not in ("outcome", "acted_us")]
    return items.join(last, ["digest_id", "n"], "left").select(*rest, F.coalesce("_o", "outcome").alias("outcome"), "acted_us")


def latest_digest(digests: DataFrame) -> DataFrame:
    return digests.orderBy(F.desc("digest_id")).limit(1)
