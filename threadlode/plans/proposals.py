"""Proposals from material: ground, ask, check the cites, compare with the ground, rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.functions.ids import proposal_id
from threadlode.functions.text import ground_line, normalize_cites, strip, within_budget
from threadlode.operators.caches import Fields, asked
from threadlode.plans.review import PARAPHRASE, novelty

CONTEXT = 6000


def grounded(material: DataFrame, notes: DataFrame) -> DataFrame:
    """(source_ref, kind, source_hash, note_ids, prompt) of material (source_ref, kind, source_hash, note_ids), whose notes
    have note_id, kind, source, text and raw (an excerpt, may be null): whole lines in order, up to ``CONTEXT``."""
    member = material.select("source_ref", F.posexplode("note_ids").alias("pos", "note_id")).join(notes.select("note_id", F.col("kind").alias("note_kind"), "source", "text", "raw"), "note_id")
    lines = member.select("source_ref", "pos", ground_line(F.col("note_id"), F.col("note_kind"), F.col("source"), F.col("text"), F.col("raw")).alias("line"))
    told = within_budget(lines, ["source_ref"], ["pos"], "line", CONTEXT).groupBy("source_ref").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    prompt = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return material.join(told, "source_ref").select("source_ref", material["kind"], "source_hash", "note_ids", prompt.alias("prompt"))


def generated(grounds: DataFrame, vectors: DataFrame, generate: Fields, critic: Fields, embedding, model: str = "", ledger: str | None = None) -> DataFrame:
    """One proposal per ground: pending, or rejected with its reason. A ground whose call failed gives none.

    ``generate`` returns title, text, next step and cites (comma-joined), ``critic`` a feasibility and a risk, or nothing:
    it labels and never filters. ``vectors(note_id, vec)``; ``embedding`` maps a text column to a vector. Without vectors
    the comparison is left out. Both are asked once per prompt; their replies are kept in the folder ``ledger`` before they are used.
    """
    made = asked(grounds.select("source_ref", "prompt"), "source_ref", generate, ("title", "text", "next_step", "cited"), ledger, "propose").where("how = 'ok'").drop("how")
    clean = [F.coalesce(strip(F.col(c)), F.lit("")).alias(c) for c in ("title", "text", "next_step")]
    p = grounds.drop("prompt").join(made.select("source_ref", *clean, F.coalesce("cited", F.lit("")).alias("cited")), "source_ref")
    p = p.withColumn("cites", normalize_cites(F.split("cited", ","), F.col("note_ids"))).withColumn("proposal_id", proposal_id(F.col("source_hash"), F.col("title")))
    ok = (F.size("cites") > 0) & (F.length("text") > 0) & (F.length("next_step") > 0)
    near = novelty(p.where(ok).select("proposal_id", embedding(F.col("text")).alias("vec")), p.where(ok).select("proposal_id", F.explode("note_ids").alias("note_id")).join(vectors, "note_id").select("proposal_id", F.col("vec").alias("note_vec")))
    p = p.join(near.select("proposal_id", "novelty_sim"), "proposal_id", "left")
    reason = F.when(~ok, "no_cites").when(F.col("novelty_sim") > PARAPHRASE, "paraphrase")
    p = p.withColumn("reject_reason", reason).withColumn("outcome", F.when(reason.isNull(), "pending").otherwise("rejected"))
    brief = F.concat("title", F.lit("\n"), "text", F.lit("\nNext step: "), "next_step")
    rated = asked(p.where("outcome = 'pending'").select("proposal_id", brief.alias("prompt")), "proposal_id", critic, ("feasibility", "risk"), ledger, "critic").drop("how")
    p = p.join(rated, "proposal_id", "left")
    # a rejected one without a title is told apart by its reason, and keeps what was said
    bare = F.length("title") == 0
    named = F.when(bare & (F.col("outcome") == "rejected"), proposal_id(F.col("source_hash"), F.col("reject_reason"))).otherwise(F.col("proposal_id"))
    gone = F.col("outcome") == "rejected"
    return p.select(
        named.alias("proposal_id"), "kind", "source_ref", "source_hash", F.when(bare & gone, "(rejected)").otherwise(F.col("title")).alias("title"), "text",
        F.when(gone, "").otherwise(F.col("next_step")).alias("next_step"), F.when(gone, F.array().cast("array<string>")).otherwise(F.col("cites")).alias("cites"),
        F.when(~gone, F.col("novelty_sim")).alias("novelty_sim"), F.col("feasibility").try_cast("double").cast("int").alias("feasibility"), "risk", F.lit(model).alias("model"), "outcome", "reject_reason",
    )
