"""The logical tables of this engine, bound to the synthetic star-schema tables (TESTDATA.md)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlode.functions.ids import DAY_US, note_id
from threadlode.functions.vectors import doubles
from threadlode.operators import links as link_ops
from threadlode.operators import themes as theme_ops
from threadlode.session import materialize

#: 2026-07-01 UTC: queries never read the clock.
NOW_US = 1_782_864_000_000_000
FIRST_US = 1_735_689_600_000_000
FLOOR = 0.3  # the synthetic vectors have no pairs above the default floor


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def messages(self) -> DataFrame:
        """One row per turn; idx counts from 0 in each session."""
        c = self.raw("conversations")
        return c.select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("session_id"), "conv_id", F.col("turn").cast("int").alias("idx"), "role", "text")

    @cached_property
    def sessions(self) -> DataFrame:
        """Sessions of user and assistant messages; every tenth is undated."""
        told = F.filter("m", lambda x: x["role"].isin("user", "assistant") & (F.length(F.trim(x["text"])) > 0))
        lines = F.transform("told", lambda x: F.concat_ws(":", x["role"], x["text"]))
        started = F.when(F.col("conv_id") % 10 == 9, None).otherwise(F.lit(FIRST_US) + ((F.col("conv_id") * 37) % 540) * DAY_US + ((F.col("conv_id") * 7919) % 86_400) * 1_000_000)
        grouped = self.messages.groupBy("session_id", "conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "text"))).alias("m"))
        return (
            grouped.withColumn("told", told)
            .where(F.size("told") > 0)
            .select("session_id", "conv_id", F.substring(F.get("told", F.lit(0))["text"], 1, 60).alias("title"), started.alias("started_us"), F.size("told").cast("long").alias("n_messages"), F.sha2(F.array_join(lines, "\n"), 256).alias("content_hash"), F.col("m").alias("messages"))
        )

    @cached_property
    def embedded(self) -> DataFrame:
        """All notes, before repeats are dropped.

        What is made of a text is made where its document is read, so plans that don't read texts shuffle none. Documents and
        vectors are merged at any size: neither is bounded, and a broadcast of the small ones' vectors would become a shuffle later."""
        d = self.raw("documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
        no = F.substring("source", 4, 20).cast("long")
        d = d.withColumn("src_no", no).withColumn("sess_no", F.expr("src_no * 10 + (vec_id div 20) % 10"))
        d = d.withColumn("session_id", F.expr("concat(source, ':s', sess_no)")).withColumn("note_id", note_id(F.col("session_id"), F.col("text")))
        rows = self.raw("embeddings").join(theme_ops.with_text_parts(d).hint("merge"), "vec_id")
        theme = (
            F.when(F.col("vec_id") % 11 == 0, None)
            .when(F.col("vec_id") % 7 == 0, F.expr("concat('theme:', label, '-s', sess_no)"))
            .otherwise(F.expr("concat('theme:', label, '-', src_no % 8)"))
        )
        return rows.select(
            "note_id", "vec_id", "session_id", "source", "src_no", "sess_no", "text", "line_hash", "head", "label",
            F.expr(f"{FIRST_US} + ((sess_no * 37) % 540) * {DAY_US} + ((sess_no * 7919) % 86400) * 1000000").alias("created_us"),
            theme.alias("theme_id"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("vec_id") % 5 + 1).cast("int")).alias("kind"), doubles(F.col("embedding")).alias("vec"),
        )

    @cached_property
    def notes(self) -> DataFrame:
        """One row per note id: of the same text in the same session the first is kept."""
        first = Window.partitionBy("note_id").orderBy("vec_id")
        return self.embedded.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")

    @cached_property
    def kept(self) -> DataFrame:
        """The notes without their texts, written once, for plans that read them several times; ``told`` has the texts of few."""
        return materialize(self.notes.drop("text"), "notes")

    def told(self, ids: DataFrame) -> DataFrame:
        """The notes of ``ids(note_id)``, a bounded number, with their texts and without vectors, written. Texts are looked up where the documents lie."""
        few = self.kept.join(F.broadcast(ids.distinct()), "note_id", "left_semi").drop("vec", "line_hash", "head")
        d = self.raw("documents").select(F.col("doc_id").alias("vec_id"), "text")
        rows = d.join(F.broadcast(few), "vec_id").where(note_id(F.col("session_id"), F.col("text")) == F.col("note_id"))  # of a repeated doc_id only the note's own text
        return materialize(rows.dropDuplicates(["note_id"]), "notes-told")

    @cached_property
    def ends(self) -> DataFrame:
        """The notes at the ends of the links, at most two a link, with their texts."""
        return self.told(link_ops.ends(self.links))

    @cached_property
    def rollup(self) -> DataFrame:
        """A derived table, written once: status, labels and mutes all come from it."""
        return materialize(theme_ops.rollup(self.kept), "themes")

    @cached_property
    def known_status(self) -> DataFrame:
        """Earlier verdicts: the themes of label 3 were resolved."""
        return self.rollup.where(F.col("theme_id").startswith("theme:3-")).select("content_hash", F.lit("resolved").alias("known_status"))

    @cached_property
    def themes(self) -> DataFrame:
        return theme_ops.status(self.rollup, NOW_US, self.known_status)

    @cached_property
    def muted(self) -> DataFrame:
        """The labels of every ninth theme, as the user would have typed them."""
        return self.rollup.where(F.col("theme_id").endswith("-5")).select(F.lower(F.trim("label")).alias("label_lc")).distinct()

    @cached_property
    def links(self) -> DataFrame:
        """A derived table of at most 200 rows, written once; a quarter of them were explained before."""
        rows = link_ops.links(self.kept, FLOOR)
        why = F.when(F.col("link_id").rlike("[0-3]$"), F.concat(F.lit("explained: "), "to_note"))
        return materialize(rows.withColumn("why", why), "links")

    @cached_property
    def proposals(self) -> DataFrame:
        """Ideas taken from documents, judged by the labels table."""
        d = self.raw("documents").select("doc_id", F.substring("text", 1, 40).alias("title"))  # the join takes titles, not texts
        rows = d.join(self.raw("labels"), "doc_id", "left")
        outcome = F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "kept").otherwise("dismissed")
        return rows.select(
            F.concat(F.lit("prop:"), F.col("doc_id").cast("string")).alias("proposal_id"), "doc_id", "title", outcome.alias("outcome"),
            F.when(F.col("doc_id") % 6 == 5, None).otherwise((F.col("doc_id") % 6).cast("int")).alias("feasibility"),
            F.when(outcome == "rejected", F.when(F.col("doc_id") % 2 == 0, "paraphrase").otherwise("no valid cites")).alias("reject_reason"),
        )

    @cached_property
    def digest_log(self) -> DataFrame:
        """Items of weekly digests: the events of a week. Of themes that end in 0, 3 or 6 a third of the items was dismissed;
        of all a third was kept, and the rest was only shown."""
        e = self.raw("events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type")
        first = e.agg(F.min("ts_us").alias("first_us"))
        rows = e.join(F.broadcast(first)).withColumn("digest_id", F.expr(f"(ts_us - first_us) div {7 * DAY_US} + 1"))  # one row
        outcome = F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") % 8).isin(0, 3, 6), "dismissed").when(F.col("event_id") % 3 == 1, "kept").otherwise("shown")
        return rows.select("digest_id", "event_id", "ts_us", F.concat(F.lit("theme:"), (F.col("user_id") % 10).cast("string"), F.lit("-"), (F.col("event_id") % 8).cast("string")).alias("theme_ref"), F.when(F.col("event_id") % 2 == 0, "nudge").otherwise("connection").alias("kind"), outcome.alias("outcome"))

    @cached_property
    def commits(self) -> DataFrame:
        """Commits that carry out what was talked about: the benchmark's texts."""
        return self.raw("benchmark").select(F.col("item_id").alias("pos"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("sha"), F.col("text").alias("message"))

    @cached_property
    def health(self) -> DataFrame:
        """A model's record for each nation: every fifth was never called, every seventh cools down for ever."""
        n = self.raw("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
        calls = F.when(F.col("k") % 5 == 0, 0).otherwise(F.expr("k * 13 % 7 + 1")).cast("long")
        until = F.when(F.col("k") % 7 == 3, 9e12).otherwise(F.when(F.col("k") % 2 == 0, 0.0).otherwise(NOW_US / 1e6 + 60))
        return n.select(
            F.concat(F.lit("p"), F.col("r").cast("string")).alias("provider"), F.concat(F.lit("m"), F.col("k").cast("string")).alias("model"), until.alias("cooldown_until"), (F.col("k") % 4).cast("int").alias("rung"),
            (F.col("k") % 3).cast("int").alias("consecutive"), F.when(F.col("k") % 3 == 0, 0.25).alias("est_rate"), F.lit(0.0).alias("last_success"), F.lit(0.0).alias("last_call"), calls.alias("calls"), (calls * 100).alias("sent_bytes"), (calls * 7).alias("recv_bytes"),
        )

    def meta(self, **values: str) -> DataFrame:
        return self.spark.createDataFrame([*values.items()], "key string, value string")

    def vector(self, vec_id: int = 0) -> list[float]:
        row = self.raw("embeddings").where(F.col("vec_id") == vec_id).select(doubles(F.col("embedding")).alias("v")).first()
        return row["v"] if row else [0.0]


#: The kinds of notes.
KINDS = ("idea", "decision", "question", "problem", "insight")
