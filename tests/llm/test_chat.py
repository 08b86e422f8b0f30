from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlode.llm import chat
from threadlode.llm.queries import TRICKY


def _fold(spark, events):
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, msg string, role string, text string")
    return [(r["role"], r["text"]) for r in chat.fold(df).orderBy("conv_id", "place").collect()]


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "delta", "u1", "user", "Hel"), (1, 2, "delta", "u1", None, "lo"), (1, 3, "delta", "a1", "assistant", "Wrong"),
        (1, 4, "delta", "u2", "user", "gone"), (1, 5, "regenerate", "a1", "assistant", "Ri"), (1, 6, "delta", "a1", None, "ght"),
        (1, 7, "edit", "u1", None, "Hi"), (1, 8, "delta", "u1", None, "!"), (1, 9, "delta", "u3", "user", None),
    ]
    expected = [("user", "Hi!"), ("assistant", "Right"), ("user", "")]
    assert _fold(spark, log) == expected
    assert _fold(spark, log[::-1]) == expected


def test_nulls_ties_and_repeats(spark):
    assert _fold(spark, [(None, 1, None, "m", None, None)]) == [("", "")]
    assert _fold(spark, [(1, 1, "delta", "m", "user", "a"), (1, 1, "delta", "m", "user", "a")]) == [("user", "aa")]
    assert _fold(spark, []) == []


def _plain_fold(events):
    """A conversation's events one by one: messages by key, in the order of their first event."""
    log = sorted(((e[1], e[3], e[2] or "delta", e[4], e[5] or "") for e in events), key=lambda e: (e[0], e[1], e[2], e[3] is not None, e[3] or "", e[4]))
    opened, pieces, roles = {}, {}, {}
    for at, (_, msg, kind, role, text) in enumerate(log):
        opened.setdefault(msg, at)
        if role is not None:
            roles[msg] = role
        if kind in ("edit", "regenerate"):
            pieces[msg] = []
        if kind == "regenerate":
            for m in [m for m in pieces if opened[m] > opened[msg]]:
                del pieces[m]
        pieces.setdefault(msg, []).append(text)
    return [(roles.get(m, ""), "".join(pieces[m])) for m in sorted(pieces, key=opened.get)]


def test_random_logs_against_a_plain_fold(spark):
    import random

    r = random.Random(7)
    events, want = [], []
    for conv in range(150):
        own = [(conv, r.randint(0, 30), r.choice(["delta", "delta", "delta", "edit", "regenerate", None]), f"m{r.randint(0, 5)}", r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "cd"])) for _ in range(r.randint(1, 25))]
        events += own
        want += _plain_fold(own)
    r.shuffle(events)
    assert _fold(spark, events) == want


def test_escape_is_reversible(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["<", "|", "\\", "im_start", "<|im_end|>", "\n", "n", "\0", "é", "$1", "x"]), max_size=10).map("".join), min_size=30, max_size=60))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        e, role = chat.escape(F.col("t")), chat.escape_role(F.col("t"))
        for r in df.select("t", e.alias("e"), chat.unescape(e).alias("u"), role.alias("er"), chat.unescape_role(role).alias("r")).collect():
            assert r["u"] == r["t"] == r["r"] and "<|" not in r["e"] and "<|" not in r["er"] and "\n" not in r["er"]

    check()


def test_turns_against_brute_force(spark):
    turns = [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY), (1, 1, "assistant", "b\\<\\|"), (1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, "we\nird\\n", "é" * 5000), (None, 3, "assistant", "z")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(chat.turn_events(df)))).collect()}
    assert len(got) == 4
    for conv in got:
        own = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        learned = "".join(x for _, r, x in own if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
