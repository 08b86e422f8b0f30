"""Deterministic identities, each a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def session_id(source: Column, native_id: Column) -> Column:
    return F.concat_ws(":", source, native_id)


def source_of(session: Column) -> Column:
    return F.substring_index(session, ":", 1)


def content_hash(messages: Column) -> Column:
    """Over roles and texts only: titles and times don't count as changes."""
    return F.sha2(F.to_json(F.transform(messages, lambda m: F.array(m["role"], m["text"]))), 256)


def note_id(session: Column, text: Column) -> Column:
    return F.concat(F.lit("note:"), F.substring(F.sha2(F.concat(session, F.lit("\n"), text), 256), 1, 16))


def link_id(a: Column, b: Column) -> Column:
    """The same for either order."""
    return F.concat(F.lit("link:"), F.substring(F.sha2(F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b)), 256), 1, 16))


def proposal_id(source_hash: Column, title: Column) -> Column:
    return F.concat(F.lit("prop:"), F.substring(F.sha2(F.concat(source_hash, F.lit("|"), title), 256), 1, 8))


def members_hash(lines: Column) -> Column:
    """Of hashes of ``id:text`` lines, in any order: hashes are collected, never the texts."""
    return F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)


def set_hash(h: Column) -> Column:
    """An aggregate: the hash of a group's lines in any order, by sums of the eight 32-bit parts of each line's hash ``h`` (sha256, in hex).

    Sums of parts of a group add up to the group's, so a group of any size is hashed where its rows lie, and no list is made.
    Exact up to 2^31 lines. It tells changes; it isn't made to withstand someone who looks for another set of the same hash.
    """
    sums = [F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")).cast("string") for k in range(8)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums), 256)


def gap_days(a_us: Column, b_us: Column) -> Column:
    """|floor of the signed difference in days|: 1.5 days apart gives 1 or 2, by the order of the two."""
    return F.abs(F.floor((a_us - b_us) / F.lit(float(DAY_US)))).cast("long")
