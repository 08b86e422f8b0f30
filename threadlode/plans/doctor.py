"""Checks of the whole store, and the repairs that lose nothing: only derived rows are ever touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlode.functions.ids import DAY_US
from threadlode.operators import store

STALE_REFRESH_DAYS = 14
#: No cooldown is longer than a day; one beyond this is a broken record.
SANE_COOLDOWN_S = 25 * 3600


def finding(df: DataFrame, name: str, status: Column, detail: Column, repairable: Column | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("name"), status.alias("status"), detail.cast("string").alias("detail"), F.coalesce(repairable if repairable is not None else F.lit(False), F.lit(False)).alias("repairable"))


def _counted(df: DataFrame, name: str, what: str, fix: bool) -> DataFrame:
    """ok without rows, else repaired, or a warning of what can be repaired."""
    n = df.agg(F.count("*").alias("n"))
    some = F.col("n") > 0
    return finding(n, name, F.when(~some, "ok").when(F.lit(fix), "repaired").otherwise("warn"), F.when(some, F.concat(F.col("n").cast("string"), F.lit(f" {what}"))).otherwise("none"), some & F.lit(not fix))


def bogus_cooldowns(health: DataFrame, now_us: int) -> DataFrame:
    return health.where(F.col("cooldown_until") > now_us / 1e6 + SANE_COOLDOWN_S)


def checks(tables: dict[str, DataFrame], expected: tuple[str, ...], surroundings: dict, now_us: int, version: int, fix: bool = False) -> DataFrame:
    """(name, status, detail, repairable), a row a check; status: ok, repaired, warn or fail.

    ``tables``: notes (note_id, session_id, pipeline_version), embeddings, links, digests, health and meta; ``expected``
    are the tables that a store has to have. ``surroundings`` is what only the caller can see: ``provider`` and ``has_key``,
    ``sources`` (name -> files), ``model_cached``, ``config_mode`` (octal text, or null) and ``pending_flag``.
    """
    notes, meta = tables["notes"], tables["meta"]
    one = notes.sparkSession.range(1)
    say = lambda name, good, yes, no, bad="warn", can=False: finding(one, name, F.lit("ok" if good else "repaired" if can and fix else bad), F.lit(yes if good else no), F.lit(bool(can and not good and not fix)))
    lost = sorted(set(expected) - set(tables))
    keys = notes.groupBy("note_id").agg(F.count("*").alias("c")).where("c > 1 or note_id is null").agg(F.count("*").alias("n"))
    mode, sources = surroundings.get("config_mode"), surroundings.get("sources") or {}
    flag = tables["digests"].agg(F.count("*").alias("n")).withColumn("bad", F.lit(bool(surroundings.get("pending_flag"))) & (F.col("n") == 0))
    refresh = meta.where("key = 'last_refresh'").agg(F.max("value").alias("v")).withColumn("at", F.try_to_timestamp(F.get_json_object("v", "$.at")))
    age = F.floor((F.lit(now_us) - F.unix_micros("at")) / DAY_US)
    unsound = F.col("v").isNull() | (F.get_json_object("v", "$.degraded") == "true") | F.get_json_object("v", "$").isNull() | (age > STALE_REFRESH_DAYS)
    told = F.when(F.col("v").isNull(), "never ran").when(F.get_json_object("v", "$").isNull(), "unreadable record").when(F.get_json_object("v", "$.degraded") == "true", "degraded").when(F.col("at").isNull(), "recorded").otherwise(F.concat(age.cast("string"), F.lit(" days ago")))
    drift = notes.where(F.col("pipeline_version") < version).agg(F.countDistinct("session_id").alias("n"))
    parts = [
        say("concurrent readers", True, "tables are written whole and replaced whole", ""),
        say("schema", not lost, f"{len(expected)} tables present", f"missing: {', '.join(lost)}", can=True),
        finding(keys, "store integrity", F.when(F.col("n") > 0, "fail").otherwise("ok"), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" note ids are null or repeated"))).otherwise("keys are unique")),
        _counted(store.orphaned(tables["embeddings"], notes), "orphaned embeddings", "rows without a note", fix),
        _counted(store.dangling(tables["links"], notes), "dangling links", "links to missing notes", fix),
        say("config permissions", mode in (None, "600"), "no config file" if mode is None else "0600", f"was 0{mode}", can=True),
        finding(flag, "digest flag", F.when(F.col("bad"), F.lit("repaired" if fix else "warn")).otherwise("ok"), F.when(F.col("bad"), "flag set but no digest exists").otherwise("no pending flag or a digest for it"), F.col("bad") & F.lit(not fix)),
        _counted(bogus_cooldowns(tables["health"], now_us), "model cooldowns", "impossible cooldowns", fix),
        say("provider key", surroundings.get("has_key"), f"{surroundings.get('provider')} key configured", f"no key for {surroundings.get('provider')}", "fail"),
        say("sources", sources, ", ".join(f"{k} ({v} files)" for k, v in sorted(sources.items())), "none detected"),
        say("embedding model", surroundings.get("model_cached"), "cached", "not downloaded yet"),
        finding(refresh, "last refresh", F.when(F.coalesce(unsound, F.lit(False)), "warn").otherwise("ok"), told),
        finding(drift, "pipeline version", F.when(F.col("n") > 0, "warn").otherwise("ok"), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" sessions distilled by an older pipeline"))).otherwise(f"version {version} everywhere")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def repaired(tables: dict[str, DataFrame], now_us: int) -> dict[str, DataFrame]:
    """Embeddings and links without what refers to missing notes, and health with broken cooldowns reset."""
    notes, links, health = tables["notes"], tables["links"], tables["health"]
    bad = F.col("cooldown_until") > now_us / 1e6 + SANE_COOLDOWN_S
    reset = [F.when(bad, F.lit(0).cast(t)).otherwise(F.col(c)).alias(c) if c in ("cooldown_until", "rung", "consecutive") else F.col(c) for c, t in health.dtypes]
    return {
        "embeddings": tables["embeddings"].join(notes.select("note_id"), "note_id", "left_semi"),
        "links": links.join(store.dangling(links, notes).select("link_id"), "link_id", "left_anti"),
        "health": health.select(*reset),
    }
