"""Substring dedup with compact windows.

Tokens are five-word shingles. For each of ``HASHES`` min-hash functions a document's compact windows (l, c, r) are the
nodes of the Cartesian tree over its tokens' hashes whose range [l, r] holds at least ``LEAST`` tokens: every passage
within [l, r] that spans c has its min-hash at c, so all its passages share one record, about 2 n / LEAST of them in
all. Only the least token of some run of ``LEAST`` tokens can be such a node, and so can its neighbours in the tree, so
the tree is built over those few positions alone.

Windows with the same signature meet in one place. There each is joined with a leader if both windows reach far enough
around their common token for a passage of 0.8 * LEAST tokens and agree in a token some way off; those that fit no leader yet give the next one, so all
are tried, with one pair per window and never all pairs. The same is done before the shuffle within each batch, so a
signature shared by a third of all documents sends one row per batch. Pairs are verified on all tokens: along the
alignments found, every run of ``LEAST`` tokens with a Jaccard similarity of 0.8 or more belongs to a repeated passage.

A window may join a leader that it shares a mere line with, and would then meet no other. So where three or more windows
of the first function met under a signature, all runs of ``LEAST`` tokens in them meet once more, by their content:
documents that share a passage word for word share such a run, whatever else they have in common with others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.llm.common import map_batches
from threadlode.session import materialize, release

SHINGLE = 5
WORDS = 50
LEAST = WORDS - SHINGLE + 1
HASHES = 4
SIMILAR = 0.8
#: Equal tokens that two aligned runs of LEAST need for a Jaccard similarity of SIMILAR.
EQUAL = int(np.ceil(2 * SIMILAR * LEAST / (1 + SIMILAR)))
#: Alignments this close are taken together: words put in or left out shift them.
SHIFT = 12
#: Words put in or left out beyond a common token that its alignment allows for.
BESIDE = 2
#: Where tokens are compared before texts are: windows that merely share a line are left out early. A passage with one
#: changed word agrees with its counterpart up to that word on either side of the common token, so that one of these
#: places is the same unless the change lies within five tokens and the passage ends as near on the other side.
AROUND = (-20, -15, -10, -5, 5, 10, 15, 20)

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and each text's number of words; words as in ``str.split`` on ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = flat.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    hashed = known[words.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    empty = hashed == np.uint64(xxhash.xxh64_intdigest(""))
    if empty.any():  # leading or trailing white space gives empty words
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[~empty]
        return hashed[~empty], np.bincount(of, minlength=len(offsets) - 1)
    return hashed, np.diff(offsets)


def shingles(words: np.ndarray) -> np.ndarray:
    """Token hashes of consecutive words (those across texts included)."""
    n = max(0, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x100000001B3) + words[k : k + n]
    return _mix(out)


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of v[i : i + width] for every i."""
    have, out = 1, v
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _lesser_before(v: np.ndarray) -> np.ndarray:
    """Position of the nearest lesser value before each; position 0 must hold the least value."""
    at = np.maximum(np.arange(len(v)) - 1, 0)
    active = np.flatnonzero(v[at] > v)
    while len(active):
        at[active] = at[at[active]]
        active = active[v[at[active]] > v[active]]
    return at


def compact_windows(shingled: np.ndarray, starts: np.ndarray, sizes: np.ndarray, function: int) -> tuple[np.ndarray, ...]:
    """(document, c, left, right) of the windows of several documents, and their signatures.

    ``starts`` and ``sizes`` (>= LEAST) are the documents' ranges in ``shingled``; left and right are the tokens between
    c and the window's ends. Of equal hashes the leftmost is least.
    """
    n = int(sizes.sum())
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(n) - first[of]
    token = shingled[starts[of] + place]
    hashed = _mix(token * np.uint64(_ODD[function % len(_ODD)]) + np.uint64(function))
    value = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    low = _sliding_least(value, LEAST)
    whole = place[: len(low)] + LEAST <= sizes[of[: len(low)]]
    c = np.unique((low[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    # a least value before each document's nodes, and one after all
    at = np.concatenate([np.searchsorted(c, first), [len(c)]])
    v = np.insert(np.maximum(value[c], np.uint64(1)), at, np.uint64(0))
    edge = np.insert(c, at, np.concatenate([first - 1, [n]]))
    mine = np.insert(np.ones(len(c), bool), at, False)
    before = _lesser_before(v)
    turned = v[::-1].copy()
    after = len(v) - 1 - _lesser_before(turned)[::-1]
    # the next document's edge marks this one's end as well
    last = np.insert(c, at, np.concatenate([first[:1] - 1, first[1:], [n]]))
    left = edge[mine] - edge[before[mine]] - 1
    right = last[after[mine]] - edge[mine] - 1
    return of[c], place[c], left, right, _mix(token[c] + np.uint64(function * 0x51_7CC1B7)).view(np.int64)


def surroundings(token: np.ndarray, c: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A byte of each of the tokens ``AROUND`` c in its document; 0 beyond its ends."""
    out = np.zeros(len(c), np.int64)
    for k, step in enumerate(AROUND):
        at = c + step
        inside = (at >= 0) & (at < size)
        byte = (token[first + np.where(inside, at, 0)] & np.uint64(0xFF)).astype(np.int64)
        out |= np.where(inside, np.maximum(byte, 1), 0) << (8 * k)
    return out


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether any of the bytes is the same and not 0."""
    out = np.zeros(len(x), bool)
    for k in range(len(AROUND)):
        a, b = (x >> (8 * k)) & 0xFF, (y >> (8 * k)) & 0xFF
        out |= (a == b) & (a > 0)
    return out


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of the bytes of x is 0 or the one of y."""
    out = np.ones(len(x), bool)
    for k in range(len(AROUND)):
        a, b = (x >> (8 * k)) & 0xFF, (y >> (8 * k)) & 0xFF
        out &= (a == b) | (a == 0)
    return out


def _partners(m: np.ndarray, t: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows m[own] of their leader's document: the first window of another document that met leader t (ascending),
    and whether there is one."""
    at = np.searchsorted(t[other], t[own])
    to = np.append(t[other], -1)[at]
    return np.append(m[other], -1)[at], to == t[own]


def lead(key: np.ndarray, doc: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (member, leader) of windows, sorted by key, that reach far enough around their common token and agree
    in a token some way off: a passage of LEAST tokens reaches four of those at least, and one changed word spoils or
    shifts those on one side only.

    Further windows of a leader's own document are aligned with the first other document that met it. Without one they
    may lead themselves, but for those that reach no further than their leader, whom nobody else can fit."""
    alive = np.arange(len(key))
    members, leaders = [], []
    while len(alive) > 1:
        k = key[alive]
        new = np.r_[True, k[1:] != k[:-1]]
        top = np.maximum.accumulate(np.where(new, np.arange(len(alive)), 0))
        m, t = alive[~new], alive[top[~new]]
        fits = (np.minimum(left[m], left[t]) + np.minimum(right[m], right[t]) + 1 >= SIMILAR * LEAST) & _alike(near[m], near[t])
        other = fits & (doc[m] != doc[t])
        own = fits & ~other
        partner, met = _partners(m, t, own, other)
        members += [m[other], m[own][met]]
        leaders += [t[other], partner[met]]
        gone = fits.copy()
        x, y = m[own], t[own]
        gone[own] = met | ((left[x] <= left[y]) & (right[x] <= right[y]) & _within(near[x], near[y]))
        alive = m[~gone]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *members]), np.concatenate([none, *leaders])


#: What a row of the first function tells: its window stands for itself, or for others too, or only its place is told.
ALONE, LEADS, PLACE = 1, 2, 3
ROW = "key long, a long, ca int, la int, ra int, near long, b long, shift int, tells int"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _sizes(key: np.ndarray) -> np.ndarray:
    """How many rows have each row's key; ``key`` is sorted."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(key)])
    return np.repeat(size, size)


def _apart(doc: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Keys for rows that needn't meet under their signature, which many may share."""
    return _mix(doc.view(np.uint64) * np.uint64(_ODD[0]) + c.astype(np.uint64)).view(np.int64)


def _rows(*columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t, from_pandas=False) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _windows(batches):
    """Windows (b null), one per signature and far-reaching group in a batch, and the pairs found within the batch."""
    for batch in batches:
        doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        words, counts = tokens(batch.column("text"))
        long = np.flatnonzero(counts >= WORDS)
        if not len(long):
            continue
        starts = (np.cumsum(counts) - counts)[long]
        shingled = shingles(words)
        parts = [compact_windows(shingled, starts, counts[long] - SHINGLE + 1, f) for f in range(HASHES)]
        of, c, left, right, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = doc_ids[long][of].astype(np.int64)
        near = surroundings(shingled, c, starts[of], counts[long][of] - SHINGLE + 1)
        tells = np.zeros(len(key), np.int32)
        tells[: len(parts[0][0])] = ALONE
        order = np.lexsort((c, doc, key))
        doc, c, left, right, key, near, tells = (x[order] for x in (doc, c, left, right, key, near, tells))
        m, t = lead(key, doc, c, left, right, near)
        two = (tells[m] == ALONE) & (_sizes(key)[m] == 2)  # they meet after the shuffle, with any others
        m, t = m[~two], t[~two]
        if len(m):  # pairs are found already
            yield _rows(_apart(doc[m], c[m]), doc[m], c[m], left[m], right[m], near[m], doc[t], c[t] - c[m], np.zeros(len(m), np.int32))
        tells[t] = np.where(tells[t] == ALONE, LEADS, tells[t])
        kept = np.ones(len(key), bool)
        kept[m] = False  # its leader stands for it
        for rows, name, told in ((kept, key, tells), (~kept & (tells > 0), _apart(doc, c), np.full(len(key), PLACE))):
            none = pa.nulls(int(rows.sum()), pa.int64())
            yield _rows(name[rows], doc[rows], c[rows], left[rows], right[rows], near[rows], none, none.cast(pa.int32()), told[rows])


def _meet(batches):
    """Pairs of (a, b, shift) from rows sorted by key; a key's rows may span batches. Places (a, null, c) of windows that
    have to meet by their content too."""
    held: list[np.ndarray] | None = None

    def places(doc, c):
        return pa.record_batch([pa.array(doc, pa.int64()), pa.nulls(len(doc), pa.int64()), pa.array(c, pa.int32())], ["a", "b", "shift"])

    def pairs(rows):
        order = np.lexsort((rows[2], rows[1], rows[0]))
        key, doc, c, left, right, near, tells = (x[order] for x in rows)
        m, t = lead(key, doc, c, left, right, near)
        yield pa.record_batch([doc[m], doc[t], (c[t] - c[m]).astype(np.int32)], ["a", "b", "shift"])
        size = _sizes(key)
        open_ = tells == LEADS
        open_[m] |= size[m] > 2
        again = np.isin(key, key[open_]) & (tells > 0)
        yield places(doc[again], c[again])

    for batch in batches:
        found = batch.filter(pc.is_valid(batch.column("b")))
        if found.num_rows:
            yield found.select(["a", "b", "shift"])
        place = pc.equal(batch.column("tells"), PLACE)
        told = batch.filter(place)
        if told.num_rows:
            yield places(told.column("a"), told.column("ca"))
        own = batch.filter(pc.and_(pc.is_null(batch.column("b")), pc.invert(place)))
        if not own.num_rows:
            continue
        rows = [own.column(x).to_numpy(zero_copy_only=False) for x in (*_NAMES[:6], "tells")]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = rows[0] == rows[0][-1]
        held = [x[last] for x in rows]
        yield from pairs([x[~last] for x in rows])
    if held is not None:
        yield from pairs(held)


RUN = "key long, a long, ca int, b long, shift int"
_RUN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]


def runs_around(coded: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of LEAST tokens that span one of ``places``, and hashes of their tokens."""
    last = len(coded) - LEAST
    places = places[places < len(coded)]
    if last < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.zeros(last + 2, np.int64)
    np.add.at(spans, np.maximum(0, places - LEAST + 1), 1)
    np.add.at(spans, np.minimum(places, last) + 1, -1)
    starts = np.flatnonzero(np.cumsum(spans) > 0)
    out = np.zeros(len(starts), np.uint64)
    for k in range(LEAST):
        out = (out + coded[starts + k] + np.uint64(1)) * np.uint64(_ODD[0])
        out ^= out >> np.uint64(32)
    return starts, out.view(np.int64)


def _match(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (member, leader) of equal runs, sorted by key and document: each run of another document goes with the
    first run, and the first document's own further ones with the first run of another document."""
    new = np.r_[True, key[1:] != key[:-1]]
    top = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    m, t = np.flatnonzero(~new), top[~new]
    other = doc[m] != doc[t]
    partner, met = _partners(m, t, ~other, other)
    return np.concatenate([m[other], m[~other][met]]), np.concatenate([t[other], partner[met]])


def _runs(batches):
    """Runs (b null), each content once per batch, and the pairs found within the batch."""
    for batch in batches:
        parts = []
        for doc_id, coded, places in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), batch.column("places").to_pylist(), strict=True):
            starts, key = runs_around(np.frombuffer(coded, "<u2"), np.array(places, np.int64))
            parts.append((key, np.full(len(key), doc_id, np.int64), starts))
        if not parts:
            continue
        key, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(key):
            continue
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        m, t = _match(key, doc)
        kept = np.ones(len(key), bool)
        kept[m] = False
        none = pa.nulls(int(kept.sum()), pa.int64())
        for columns in ((_apart(doc[m], at[m]), doc[m], at[m], doc[t], at[t] - at[m]), (key[kept], doc[kept], at[kept], none, none.cast(pa.int32()))):
            yield pa.record_batch([pa.array(c, t, from_pandas=False) for c, t in zip(columns, _RUN_TYPES, strict=True)], [x.split()[0] for x in RUN.split(", ")])


def _meet_again(batches):
    """Pairs of (a, b, shift) from rows sorted by key; a key's rows may span batches."""
    held: list[np.ndarray] | None = None

    def pairs(rows):
        order = np.lexsort((rows[2], rows[1], rows[0]))
        key, doc, at = (x[order] for x in rows)
        if len(key):
            m, t = _match(key, doc)
            yield pa.record_batch([doc[m], doc[t], (at[t] - at[m]).astype(np.int32)], ["a", "b", "shift"])

    for batch in batches:
        found = batch.filter(pc.is_valid(batch.column("b")))
        if found.num_rows:
            yield found.select(["a", "b", "shift"])
        own = batch.filter(pc.is_null(batch.column("b")))
        if not own.num_rows:
            continue
        rows = [own.column(x).to_numpy(zero_copy_only=False) for x in ("key", "a", "ca")]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = rows[0] == rows[0][-1]
        held = [x[last] for x in rows]
        yield from pairs([x[~last] for x in rows])
    if held is not None:
        yield from pairs(held)


def repeated(a: np.ndarray, b: np.ndarray, shifts: list[int]) -> list[tuple[int, int, int, int]]:
    """Verified passages of two documents' tokens: (start, end) in a and in b, end exclusive, along ``shifts`` (b - a) and,
    as a word put in or left out shifts what lies beyond it, along those ``BESIDE`` them."""
    out = []
    shifts = sorted(set(shifts))
    groups: list[list[int]] = []
    for s in shifts:
        if groups and s - groups[-1][-1] <= SHIFT:
            groups[-1].append(s)
        else:
            groups.append([s])
    for group in groups:
        equal, to = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        given = {*group}
        beside = [s for s in range(group[0] - BESIDE, group[-1] + BESIDE + 1) if s not in given]
        for s in [*group, *beside]:
            low, high = max(0, -s), min(len(a), len(b) - s)
            if high > low:
                same = a[low:high] == b[low + s : high + s]
                to[low:high] = np.where(same & ~equal[low:high], np.arange(low, high) + s, to[low:high])
                equal[low:high] |= same
        if equal.sum() < EQUAL:
            continue
        total = np.concatenate([[0], np.cumsum(equal)])
        runs = np.flatnonzero(total[LEAST:] - total[:-LEAST] >= EQUAL)
        if not len(runs):
            continue
        breaks = np.flatnonzero(np.diff(runs) > LEAST)
        for i, j in zip(np.r_[0, breaks + 1], np.r_[breaks, len(runs) - 1], strict=True):
            inside = np.flatnonzero(equal[runs[i] : runs[j] + LEAST]) + runs[i]
            out.append((int(inside[0]), int(inside[-1]) + 1, int(to[inside].min()), int(to[inside].max()) + 1))
    return out


def _coded(batches):
    """(doc_id, tokens): two bytes of every token, from the first to the last. Of 46 such values 41 have to be equal in
    turn, so chance agreement doesn't matter, and they're a third of the text."""
    for batch in batches:
        words, counts = tokens(batch.column("text"))
        ends = np.cumsum(counts)
        coded = [shingles(words[e - n : e]).astype("<u2").tobytes() for e, n in zip(ends, counts, strict=True)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(coded, pa.binary())], ["doc_id", "tokens"])


def _verify(batches):
    for batch in batches:
        sides = [[np.frombuffer(x, "<u2") for x in batch.column(side).to_pylist()] for side in ("tokens_a", "tokens_b")]
        rows = []
        for a, b, shifts, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shifts").to_pylist(), *sides, strict=True):
            for a0, a1, b0, b1 in repeated(ta, tb, shifts):
                rows += [(a, a0, a1 + SHINGLE - 1, b), (b, b0, b1 + SHINGLE - 1, a)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start_word", "end_word", "other_id"])


def _merge(batches):
    for batch in batches:
        rows = []
        for doc_id, spans in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            at = None
            for s in sorted((x["start_word"], x["end_word"], x["other_id"]) for x in spans):
                if at and s[0] <= at[1]:
                    at[1], at[2] = max(at[1], s[1]), min(at[2], s[2])
                else:
                    at = [*s]
                    rows.append((doc_id, at))
        columns = [[d for d, _ in rows], *([x[k] for _, x in rows] for k in range(3))]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start_word", "end_word", "other_id"])


def _turned(found: DataFrame) -> DataFrame:
    """(a, b, shift) with a > b, and places (a, null, c) as they are."""
    turn = F.col("b").isNotNull() & (F.col("a") < F.col("b"))
    return found.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(turn, -F.col("shift")).otherwise(F.col("shift")).alias("shift"))


def _pairs(texts: DataFrame) -> DataFrame:
    """(a, b, shifts) with a > b: documents that may share passages, and how b's tokens are shifted against a's. Where b
    is null, ``shifts`` are the places of a's windows that have to meet by their content too."""
    windows = map_batches(texts, _windows, ROW)
    found = windows.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long, shift int")
    return materialize(_turned(found).groupBy("a", "b").agg(F.collect_set("shift").alias("shifts")), "passage-pairs")


def _pairs_by_content(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b, shifts) of ``pairs`` and of equal runs around the places it tells; ``own(doc_id, tokens)``."""
    places = pairs.where("b is null").select(F.col("a").alias("doc_id"), F.col("shifts").alias("places"))
    runs = map_batches(own.join(places, "doc_id"), _runs, RUN)
    found = runs.repartition("key").sortWithinPartitions("key").mapInArrow(_meet_again, "a long, b long, shift int")
    both = pairs.where("b is not null").select("a", "b", F.explode("shifts").alias("shift")).union(_turned(found))
    return materialize(both.groupBy("a", "b").agg(F.collect_set("shift").alias("shifts")), "all-passage-pairs")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage of 50 or more words that occurs nearly the same in another document.

    Columns: doc_id, start_word, end_word (exclusive), n_words, other_id (the smallest document it was verified with).
    Overlapping passages of a document are merged. A null text and texts under 50 words have none; a document isn't
    compared with itself. Rows with a null doc_id take no part; rows that repeat a doc_id count as one document, of which
    one text is read (the one with the greatest token codes). An empty table gives no rows.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = _pairs(texts)
    release(docs.sparkSession)
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).where("doc_id is not null").distinct()
    coded = map_batches(texts, _coded, "doc_id long, tokens binary")
    own = materialize(coded.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("tokens").alias("tokens")), "passage-tokens")
    release(docs.sparkSession)
    pairs = _pairs_by_content(pairs, own)
    release(docs.sparkSession)
    with_a = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    with_b = with_a.join(own.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    spans = map_batches(with_b, _verify, "doc_id long, start_word long, end_word long, other_id long")
    # partly merged before the shuffle: many documents may share a passage with one leader
    least = spans.groupBy("doc_id", "start_word", "end_word").agg(F.min("other_id").alias("other_id"))
    lists = least.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word", "other_id")).alias("spans"))
    merged = lists.mapInArrow(_merge, "doc_id long, start_word long, end_word long, other_id long")
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id")
