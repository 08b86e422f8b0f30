from __future__ import annotations

from pyspark.sql import functions as F

from threadlode.operators import distill, health
from threadlode.providers import InvalidReply, Unavailable


def _calls(spark, *rows):
    return spark.createDataFrame([("p", m, at, how, wait, 10, 1) for m, at, how, wait in rows], "provider string, model string, at double, outcome string, told_wait double, sent long, received long")


def test_health_by_a_plain_fold(spark):
    import random

    r = random.Random(5)
    log = [(f"m{r.randrange(4)}", float(t), r.choice(["ok", "limited", "limited", "server", None]), r.choice([None, None, 7.0, 1e9])) for t in range(160)]
    want = {}
    for m, at, how, wait in log:
        s = want.setdefault(m, {"cooldown_until": 0.0, "rung": 0, "consecutive": 0, "est_rate": None, "last_success": 0.0, "last_call": 0.0, "calls": 0, "sent_bytes": 0, "recv_bytes": 0})
        s["last_call"] = at
        if how == "ok":
            s |= {"cooldown_until": 0.0, "rung": 0, "consecutive": 0, "last_success": at, "calls": s["calls"] + 1, "sent_bytes": s["sent_bytes"] + 10, "recv_bytes": s["recv_bytes"] + 1}
            s["est_rate"] = s["est_rate"] and min(s["est_rate"] + health.GAIN, health.FASTEST)
        elif how == "limited":
            s["consecutive"] += 1
            s["rung"] = min(s["consecutive"] - 1, len(health.LADDER))
            s["est_rate"] = max(s["est_rate"] / 2, health.SLOWEST) if s["est_rate"] else health.SEED
            s["cooldown_until"] = at + min(health.LONGEST, wait if wait is not None else (*health.LADDER, health.LONGEST)[s["rung"]])
    got = {r["model"]: r.asDict() for r in health.after_calls(_calls(spark, *log)).collect()}
    assert {*got} == {*want}
    for m, s in want.items():
        rate = s.pop("est_rate")
        assert {k: got[m][k] for k in s} == s and abs(got[m]["est_rate"] - rate) < 1e-9
    assert health.after_calls(_calls(spark)).count() == 0


def test_next_models(spark):
    known = health.after_calls(_calls(spark, ("a", 10.0, "limited", 50.0), ("b", 10.0, "limited", 20.0), ("c", 10.0, "ok", None)))
    chains = spark.createDataFrame([("label", 0, "p", "a"), ("label", 1, "p", "c"), ("propose", 0, "p", "a"), ("propose", 1, "p", "c"), ("status", 0, "p", "a"), ("status", 1, "p", "b"), ("new", 0, "q", "z")], "role string, pos int, provider string, model string")
    got = {r["role"]: (r["model"], r["until"]) for r in health.next_models(chains, known, 12.0).collect()}
    assert got == {"label": ("c", None), "propose": (None, 60.0), "status": (None, 30.0), "new": ("z", None)}
    assert {r["role"]: r["model"] for r in health.next_models(chains, known, 30.0).collect()}["status"] == "b"


def _prompts(spark, n):
    return spark.createDataFrame([(f"s{k:02d}", str(k)) for k in range(n)], "session_id string, prompt string").coalesce(1).sortWithinPartitions("session_id")


def test_distilling_stops_when_cold(spark):
    def provider(prompt):
        if prompt == "3":
            raise Unavailable(9.0)
        if prompt == "1":
            raise InvalidReply("junk")
        return [("idea", f"\u2003note {prompt}\n", "msg:0")]

    rows = distill.distill(_prompts(spark, 6), provider)
    assert [r["outcome"] for r in distill.outcomes(rows).orderBy("session_id").collect()] == ["ok", "zero_note", "ok", "cold", "cold", "cold"]
    sessions = spark.createDataFrame([(f"s{k:02d}", f"h{k}", 7 if k else None) for k in range(6)], "session_id string, content_hash string, started_us long")
    assert sorted(r["content_hash"] for r in distill.checkpoint(rows, sessions, 2).collect()) == ["h0", "h1", "h2"]
    notes = distill.notes_of(rows, sessions, 2, F.lit(5)).orderBy("session_id").collect()
    assert [(r["text"], r["created_us"], r["pipeline_version"]) for r in notes] == [("note 0", 5, 2), ("note 2", 7, 2)]


def test_distilling_gives_up_after_failures_in_a_row(spark):
    def provider(prompt):
        if prompt in ("0", "1", "3", "4", "5", "6", "7"):
            raise ValueError
        return []

    got = [r["outcome"] for r in distill.outcomes(distill.distill(_prompts(spark, 10), provider)).orderBy("session_id").collect()]
    assert got == ["failed", "failed", "zero_note", "failed", "failed", "failed", "failed", "failed", "skipped", "skipped"]
