from __future__ import annotations

import random

import pytest

from threadlode.functions.ids import DAY_US
from threadlode.operators import links, refresh, themes

SCHEMA = "note_id string, theme_id string, source string, session_id string, text string, created_us long, vec array<double>"


def _note(rng, k):
    return (f"n{k:03d}", rng.choice(["t1", "t2", "t3", None]), rng.choice("xy"), f"s{rng.randrange(9)}", f"text {rng.random()}", rng.randrange(99) * DAY_US, [rng.gauss(0, 1) for _ in range(3)])


def _states(spark, seed, n=80):
    """Notes before and after: some gone, some new, some with other vectors, one with another theme, one with another time."""
    rng = random.Random(seed)
    old = [_note(rng, k) for k in range(n)]
    new = [r for k, r in enumerate(old) if k % 19] + [_note(rng, n + k) for k in range(4)]
    for at in (5, 31):
        new[at] = (*new[at][:6], [rng.gauss(0, 1) for _ in range(3)])
    new[7] = (new[7][0], "t9", *new[7][2:])
    new[8] = (*new[8][:5], None, new[8][6])
    return spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)


def _rows(df):
    return sorted(tuple(r[c] for c in ("link_id", "from_note", "to_note", "from_theme", "to_theme", "weight", "gap_days")) for r in df.collect())


@pytest.mark.parametrize("top,reserve,anew", [(20, 60, False), (20, 21, True), (5, 5000, False)])
def test_refreshed_links_are_those_made_anew(spark, monkeypatch, top, reserve, anew):
    before, after = _states(spark, top)
    stored = refresh.build_links(before, 0.3, reserve)
    assert stored.whole == (reserve == 5000) and stored.rows.count() == (reserve if reserve < 5000 else links.links(before, 0.3, None).count())
    built = []
    monkeypatch.setattr(refresh, "build_links", lambda *a, make=refresh.build_links: built.append(1) or make(*a))
    got = refresh.refresh_links(stored, before, after, 0.3, top, reserve)
    assert bool(built) == anew
    assert _rows(links.best(got.rows, top)) == _rows(links.links(after, 0.3, top))
    n = got.rows.count()
    assert n >= top and _rows(got.rows) == _rows(links.best(links.links(after, 0.3, None), n))
    if got.whole:
        assert n == links.links(after, 0.3, None).count()


def test_only_changed_notes_are_compared(spark, monkeypatch):
    before, after = _states(spark, 3)
    stored, seen = refresh.build_links(before, 0.3, 60), []
    monkeypatch.setattr(links, "heaviest", lambda notes, *a, f=links.heaviest, **k: seen.append({r["note_id"] for r in notes.collect()}) or f(notes, *a, **k))
    refresh.refresh_links(stored, before, after, 0.3, 20, 60)
    want = {r["note_id"] for r in refresh.changes(before, after, refresh.LINKED).collect() if r["change"] != "removed"}
    assert seen == [want] and 0 < len(want) < 12


def test_many_refreshes_in_a_row(spark):
    now, _ = _states(spark, 4, 40)
    stored, rng = refresh.build_links(now, 0.3, 40), random.Random(4)
    for step in range(4):
        rows = [tuple(r) for r in now.collect()]
        rows[rng.randrange(len(rows))] = _note(rng, 100 + step)
        after = spark.createDataFrame(rows, SCHEMA)
        stored, now = refresh.refresh_links(stored, now, after, 0.3, 15, 40), after
        assert _rows(links.best(stored.rows, 15)) == _rows(links.links(now, 0.3, 15))


def test_nothing_changed_and_nothing_left(spark):
    before = _states(spark, 5)[0].limit(20)
    stored = refresh.build_links(before, 0.3, 60)
    assert refresh.changes(before, before, refresh.LINKED).count() == 0
    assert _rows(refresh.refresh_links(stored, before, before, 0.3, 10, 60).rows) == _rows(stored.rows)
    gone = refresh.refresh_links(stored, before, before.limit(0), 0.3, 10, 60)
    assert gone.rows.count() == 0
    assert _rows(refresh.refresh_links(gone, before.limit(0), before, 0.3, 10, 60).rows) == _rows(stored.rows)


def test_refreshed_themes_are_those_made_anew(spark):
    before, after = _states(spark, 6)
    got = refresh.refresh_themes(themes.rollup(before), before, after)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    assert rows(got) == rows(themes.rollup(after)) != rows(themes.rollup(before))
