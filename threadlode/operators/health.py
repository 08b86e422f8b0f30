"""Models' health from the log of their calls, and the model that a role may ask next: both are joins and aggregates over tables.

The log has a row per call: provider, model, at (epoch seconds), outcome (``ok``, ``limited``, or any other word for an error), told_wait (seconds that a limit asked for, may be
null), sent and received (bytes). Rules:

* A success clears limits: only those after a model's last success count.
* The wait after a limit is what was told, or else the ladder's step: the first two limits in a row stand on its first step, each further one climbs.
* A rate is known from the first limit on. A limit halves it, a success adds to it, within bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Waits by step in seconds, the longest wait, calls a second after the first limit, at least, at most, and gained by a success.
LADDER, LONGEST = (5.0, 30.0, 120.0, 900.0, 3600.0, 21600.0), 86400.0
SEED, SLOWEST, FASTEST, GAIN = 0.25, 1 / 120, 2.0, 0.05
MODEL = ["provider", "model"]


def after_calls(calls: DataFrame) -> DataFrame:
    """Rows for the health table (``store.HEALTH``), one per (provider, model) of ``calls``. Calls at the same time count in the order limited, other, ok; a null
    outcome is an error, null bytes are none. No calls give no rows."""
    c = calls.select(*MODEL, F.col("at").cast("double").alias("at"), F.coalesce("outcome", F.lit("error")).alias("outcome"), F.col("told_wait").cast("double").alias("told_wait"), *[F.coalesce(F.col(b).cast("long"), F.lit(0)).alias(b) for b in ("sent", "received")])
    ok, limited = F.col("outcome") == "ok", F.col("outcome") == "limited"
    total = c.groupBy(*MODEL).agg(
        F.max("at").alias("last_call"), F.max(F.when(ok, F.col("at"))).alias("last_success"), F.count_if(ok).alias("calls"),
        F.coalesce(F.sum(F.when(ok, F.col("sent"))), F.lit(0)).alias("sent_bytes"), F.coalesce(F.sum(F.when(ok, F.col("received"))), F.lit(0)).alias("recv_bytes"),
    )
    since = c.where(limited).join(total.select(*MODEL, "last_success"), MODEL).where("last_success is null or at > last_success")
    row = since.groupBy(*MODEL).agg(F.count("*").cast("int").alias("consecutive"), F.max(F.struct("at", "told_wait")).alias("last"))
    rung = F.least(F.greatest(F.coalesce("consecutive", F.lit(0)) - 1, F.lit(0)), F.lit(len(LADDER)))
    step = F.get(F.array(*[F.lit(x) for x in (*LADDER, LONGEST)]), rung)
    until = F.when(F.col("last").isNotNull(), F.col("last.at") + F.least(F.coalesce("last.told_wait", step), F.lit(LONGEST)))
    # successes after each limit; a call's place among limits is a running count of them
    order = Window.partitionBy(*MODEL).orderBy("at", F.when(limited, 0).when(ok, 2).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    runs = c.withColumn("limits", F.count_if(limited).over(order)).where("limits > 0").groupBy(*MODEL, "limits").agg(F.count_if(ok).alias("gains"))
    fold = F.aggregate(F.col("runs.gains"), F.lit(2 * SEED), lambda r, n: F.least(F.lit(FASTEST), F.greatest(r / 2, F.lit(SLOWEST)) + n * F.lit(GAIN)))
    rates = runs.groupBy(*MODEL).agg(F.array_sort(F.collect_list(F.struct("limits", "gains"))).alias("runs")).select(*MODEL, fold.alias("est_rate"))
    rows = total.join(row, MODEL, "left").join(rates, MODEL, "left")
    return rows.select(*MODEL, F.coalesce(until, F.lit(0.0)).alias("cooldown_until"), rung.cast("int").alias("rung"), F.coalesce("consecutive", F.lit(0)).alias("consecutive"), "est_rate", F.coalesce("last_success", F.lit(0.0)).alias("last_success"), "last_call", "calls", "sent_bytes", "recv_bytes")


def next_models(chains: DataFrame, health: DataFrame, now: float) -> DataFrame:
    """(role, provider, model, until) for each role of ``chains(role, pos, provider, model)``: the first model that isn't cooling down, or none and when the first of
    them will be ready. The role ``propose`` has its first model alone. A model without a record is ready; of equal places the smaller name comes first."""
    first = chains.where("role = 'propose'").groupBy("role").agg(F.min(F.struct("pos", "provider", "model")).alias("x")).select("role", "x.*")
    told = chains.where("role <> 'propose'").select("role", "pos", "provider", "model").union(first)
    told = told.join(health.select(*MODEL, "cooldown_until"), MODEL, "left").withColumn("ready", F.coalesce(F.col("cooldown_until") <= now, F.lit(True)))
    best = told.groupBy("role").agg(F.min(F.when(F.col("ready"), F.struct("pos", "provider", "model"))).alias("x"), F.min("cooldown_until").alias("until"))
    return best.select("role", "x.provider", "x.model", F.when(F.col("x").isNull(), F.col("until")).alias("until"))
