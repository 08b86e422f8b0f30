"""Derived tables kept up to date from what changed in the notes, instead of being made anew."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.operators import links as link_ops
from threadlode.operators import themes as theme_ops
from threadlode.session import materialize

#: What a link and a theme are made of; a note that differs in nothing of it hasn't changed for them.
LINKED, THEMED = ("theme_id", "source", "created_us", "vec"), ("theme_id", "source", "session_id", "created_us", "text")
#: Links kept beyond the best ones, so that these are still known when some fall away.
RESERVE = 2 * link_ops.TOP


class LinkTable(NamedTuple):
    """The best links of all, best first without gaps; ``whole`` where there are no others."""

    rows: DataFrame
    whole: bool


def changes(before: DataFrame, after: DataFrame, columns: tuple[str, ...], key: str = "note_id") -> DataFrame:
    """(key, change): new, changed or removed; rows that are equal in ``columns`` are left out. Keys are unique in each."""
    side = lambda df, p: df.select(key, F.struct(*columns).alias(p))
    both = side(before, "old").join(side(after, "new"), key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def build_links(notes: DataFrame, floor: float = link_ops.FLOOR, reserve: int = RESERVE) -> LinkTable:
    return _stored(link_ops.links(notes, floor, reserve + 1), reserve, True)


def _stored(rows: DataFrame, reserve: int, whole: bool) -> LinkTable:
    """At most ``reserve`` of the links, written; one more tells whether there are others."""
    rows = materialize(rows, "links")
    n = rows.count()  # at most reserve + 1, or few times that
    return LinkTable(rows if n <= reserve else link_ops.best(rows, reserve), whole and n <= reserve)


def refresh_links(stored: LinkTable, before: DataFrame, after: DataFrame, floor: float = link_ops.FLOOR, top: int = link_ops.TOP, reserve: int = RESERVE) -> LinkTable:
    """The best links of ``after``, from those of ``before``: what has an end that changed goes, and only notes that are new or changed are
    compared, with each other and with all others.

    Links that stay are the best of all between unchanged notes, down to the last of them, so the result is cut there;
    it gets shorter with each refresh. When fewer than ``top`` are left, and there are others, all are compared anew.
    """
    touched = materialize(changes(before, after, LINKED), "changes")
    stay = stored.rows
    for end in ("from_note", "to_note"):
        stay = stay.join(touched.select(F.col("note_id").alias(end)), end, "left_anti")
    stay = materialize(stay, "links-that-stay")  # at most reserve rows, as all below
    last = stay.orderBy("weight", F.desc("from_note"), F.desc("to_note")).select("weight", "from_note", "to_note").first()
    if not stored.whole and (last is None or stay.count() < top):
        return build_links(after, floor, reserve)
    ids = touched.select("note_id")
    pairs = link_ops.heaviest(after.join(ids, "note_id", "left_semi"), floor, reserve + 1, rest=after.join(ids, "note_id", "left_anti"))
    fresh = link_ops.best(link_ops.weighed(pairs, after), reserve + 1)
    rows = stay.unionByName(fresh)
    if not stored.whole:
        order = lambda w, a, b: F.struct((-w).alias("w"), a.alias("a"), b.alias("b"))
        rows = rows.where(order(F.col("weight"), F.col("from_note"), F.col("to_note")) <= order(*map(F.lit, last)))
    return _stored(rows, reserve, stored.whole)


def refresh_themes(stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The rollup of ``after`` from that of ``before``: themes that a changed note was or is in are added up anew."""
    touched = materialize(changes(before, after, THEMED), "changes").select("note_id")
    themes = before.join(touched, "note_id", "left_semi").select("theme_id").union(after.join(touched, "note_id", "left_semi").select("theme_id"))
    themes = materialize(themes.where("theme_id is not null").distinct(), "themes-touched")
    anew = theme_ops.rollup(after.join(themes, "theme_id", "left_semi"))
    return stored.join(themes, "theme_id", "left_anti").unionByName(anew)
