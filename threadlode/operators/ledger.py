"""A durable ledger of provider replies: every prompt is asked once, and its reply is kept before anything reads it.

A reply is a row of (prompt_hash, attempt, how, reply), appended to a Parquet folder in a batch of its own, which Spark's committer makes visible as a
whole or not at all. Callers get the rows read back from there, never the plan that calls the provider, so it doesn't matter how often, or in how many branches,
they use them. A later run over the same folder asks only for prompts that have no final reply yet, with the next attempt's number; of several final
replies to a prompt (two runs at once) the first counts everywhere: the least by attempt, then by hash of the reply.

What a lost executor had asked and not yet committed is asked again: a call may be repeated then, a kept reply never.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.providers import InvalidReply, Unavailable
from threadlode.session import materialize, work_path

REPLIES = "prompt_hash string, attempt int, how string, reply string"
#: Outcomes that are final; all others are tried again by the next run.
FINAL = ("ok", "invalid")


def prompt_hash(prompt, role: str = ""):
    """The key of a prompt: the same text asked in another role is another prompt."""
    return F.sha2(F.concat(F.lit(f"{role}\n"), F.coalesce(prompt, F.lit(""))), 256)


def replies(prompts: DataFrame, key: str, provider: Callable[[str], object], folder: str | None = None, role: str = "", stop_when_cold: bool = False, most_failures: int | None = None) -> DataFrame:
    """(key, how, reply) for each row of ``prompts(key, prompt)``; ``reply`` is the JSON of what ``provider(prompt)`` returned, null unless how is ok.

    how: ``ok``; ``invalid`` (it raised InvalidReply: answered, but not with what was asked for, and final all the same); ``cold`` (Unavailable); ``failed`` (any
    other error); ``skipped`` (not asked). With ``stop_when_cold`` a task asks nothing more once it met a cold provider, and what is left is cold
    too; with ``most_failures`` it gives up after so many failures in a row, and what is left is skipped. Prompts that repeat are asked once; a null prompt counts as empty.
    A null key gets its reply like any other. Without ``folder`` the ledger is a new one.
    """
    spark = prompts.sparkSession
    folder = folder or work_path(spark, "ledger")
    rows = materialize(prompts.select(F.col(key), prompt_hash(F.col("prompt"), role).alias("prompt_hash"), F.coalesce("prompt", F.lit("")).alias("prompt")), "prompts")
    todo = rows.select("prompt_hash", "prompt")
    if todo.groupBy("prompt_hash").count().where("count > 1").limit(1).count():
        todo = todo.groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
    known = _read(spark, folder)
    if known is None:
        todo = todo.withColumn("attempt", F.lit(1))
    else:
        told = known.groupBy("prompt_hash").agg(F.max(F.col("how").isin(*FINAL)).alias("final"), F.max("attempt").alias("tried"))
        todo = todo.join(told, "prompt_hash", "left").where("final is null or not final").select("prompt_hash", "prompt", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"))

    def run(batches):
        stopped, failures = None, 0
        for batch in batches:
            out = []
            for h, prompt, attempt in zip(*(batch.column(c).to_pylist() for c in ("prompt_hash", "prompt", "attempt")), strict=True):
                how, reply = stopped, None
                if stopped is None:
                    try:
                        how, reply, failures = "ok", json.dumps(provider(prompt)), 0
                    except InvalidReply:
                        how, failures = "invalid", 0
                    except Unavailable:
                        how = "cold"
                        stopped = "cold" if stop_when_cold else None
                    except Exception:  # noqa: BLE001  a provider's failure is the prompt's outcome, and it is asked again
                        how, failures = "failed", failures + 1
                        stopped = "skipped" if most_failures and failures >= most_failures else None
                out.append((h, attempt, how, reply))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.string(), pa.string()], strict=True)], ["prompt_hash", "attempt", "how", "reply"])

    todo.mapInArrow(run, REPLIES).write.mode("append").parquet(folder)
    # a copy by a path of its own: plans that read one folder at two times count as the same to Spark, which may then reuse the older rows
    return materialize(rows.select(key, "prompt_hash").join(settled(_read(spark, folder)), "prompt_hash").select(key, "how", "reply"), "replies")


def settled(kept: DataFrame) -> DataFrame:
    """(prompt_hash, how, reply): what counts of each prompt. The first final reply, or else the latest outcome."""
    order = F.struct(F.when(F.col("how").isin(*FINAL), F.col("attempt")).otherwise(F.lit(1 << 30) - F.col("attempt")), F.sha2(F.coalesce("reply", F.lit("")), 256))
    return kept.groupBy("prompt_hash").agg(F.min_by(F.struct("how", "reply"), order).alias("x")).select("prompt_hash", "x.*")


def _read(spark, folder: str) -> DataFrame | None:
    """The ledger as it is, or none if nothing was ever kept there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(REPLIES).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
