from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from threadlode.llm import mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=8))
def test_pfair_stays_within_a_block(parts):
    own = {f"s{k}": p for k, p in enumerate(parts)}
    total = sum(parts)
    had = dict.fromkeys(own, 0)
    for t, s in enumerate(mixing.pfair(own), 1):
        had[s] += 1
        assert all(abs(had[x] - t * own[x] / total) < 1 for x in own)
    assert had == own


def _check(rows, got, parts, block):
    """Every row once, positions without gaps, and each phase within one block of its weights."""
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "") for r in got) == sorted((d is None, d or 0, s or "") for d, s in rows)
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    slots = {}
    for r in sorted(got, key=lambda r: r["position"]):
        slots.setdefault(r["slot"], set()).add(r["source"])
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    order = [slots[t].copy().pop() for t in range(len(slots))]
    left = {s: order.count(s) for s in {*order}}
    had, t, live = dict.fromkeys(left, 0), 0, {*left}
    for s in order:
        had[s] += 1
        left[s] -= 1
        t += 1
        total = sum(parts[x] for x in live)
        assert all(abs(had[x] - t * parts[x] / total) < 1 for x in live)
        if not left[s]:
            live.discard(s)
            had, t = dict.fromkeys(live, 0), 0


def test_table(spark):
    rows = [(k, "abc"[min(k % 7, 2)]) for k in range(700)] + [(k, None) for k in range(900, 930)] + [(None, "a"), (5, "c"), (5, "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, slot int").repartition(4)
    weights = {"a": 5, "b": 2, "c": 3, "other": 1}
    got = mixing.mix(df, weights, block_docs=8).collect()
    _check(rows, got, {"a": 5, "b": 2, "c": 3, None: 1}, 8)
    free = mixing.mix(df, block_docs=8).collect()
    assert sorted(r["position"] for r in free) == list(range(len(rows)))
    assert mixing.mix(df.limit(0)).count() == 0
    docs = df.withColumnRenamed("slot", "text")
    out = mixing.mixed_documents(docs, weights=weights, block_docs=8)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_every_source_keeps_its_weight_beyond_the_bound(spark):
    """40 sources, 5 alone and the others in 3 classes: prefixes stay near each source's weight while all have blocks."""
    r = random.Random(1)
    rows = [(k, f"s{min(int(r.expovariate(0.08)), 39)}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, power=1.0, most_alone=5, shared=3, block_docs=4).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(6000)) and sorted(x["position"] for x in got) == list(range(6000))
    slots = {}
    for x in got:
        slots.setdefault(x["slot"], set()).add(x["source"])
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    for s in {x["source"] for x in got}:  # a source's blocks come in order
        own = sorted((x["slot"], x["block"]) for x in got if x["source"] == s)
        assert [b for _, b in own] == sorted(b for _, b in own)
    # weights as counts: in every prefix each source is near its share, so the small ones have weights of their own
    order = [slots[t].copy().pop() for t in range(len(slots))]
    total, had = {s: order.count(s) for s in {*order}}, dict.fromkeys(order, 0)
    worst = 0.0
    for t, s in enumerate(order, 1):
        had[s] += 1
        worst = max(worst, *(abs(had[x] - t * total[x] / len(order)) for x in total))
    assert worst < 4  # two blocks by the schedules, and what rounding weights to parts adds over the whole


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.tuples(st.integers(1, 9), st.integers(1, 50)), min_size=1))
def test_schedule_gives_each_block_one_slot(sources):
    import numpy as np

    plan = mixing.Schedule({s: p for s, (p, _) in sources.items()}, {s: n for s, (_, n) in sources.items()})
    own = {s: plan.slots(s, np.arange(n)) for s, (_, n) in sources.items()}
    assert sorted(np.concatenate([*own.values()])) == list(range(sum(n for _, n in sources.values())))
    assert all((np.diff(x) > 0).all() for x in own.values())


def test_one_doc_id_for_all_and_no_source(spark):
    df = spark.createDataFrame([(None, None)] * 300, "doc_id long, source string").repartition(3)
    got = mixing.mix(df, block_docs=16).collect()
    assert sorted(x["position"] for x in got) == list(range(300)) and {x["source"] for x in got} == {None}


def test_parts():
    parts = mixing.rounded_parts({"a": 1000**0.5, "b": 10**0.5, "c": 1})
    assert sum(parts.values()) == mixing.PARTS and parts["a"] > parts["b"] > parts["c"] >= 1
