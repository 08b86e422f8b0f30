"""Personal data: exact base patterns, and a character-level BiLSTM-CRF that adds spans to them.

Base spans come from fixed patterns over whole texts. The model finds what they can't: addresses, numbers and cards as
people write them ("joe at example dot com", national telephone numbers, cards with other separators). It is trained in
numpy on the driver from labelled spans: windows of a bounded sample of documents (``SAMPLE_DOCS``), labelled by the base
patterns, and as many with made-up entities of all ways of writing, half of them put into the documents' own words, and
with numbers and words that are none.

Every window of every text is read, ``WINDOW`` characters that overlap; each character's scores are those of the window in
which it is most central. Where the scores prove that the best path stays outside (``restless``), nothing more is
needed; all other windows and their neighbours are joined to runs, and each run is decoded as one sequence, so that no
entity is cut at a seam. A span counts if its mean marginal probability reaches ``CONFIDENCE``, it is plausible for its
kind (an added card passes Luhn, an added address has four numbers up to 255) and it overlaps no base span.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlode.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, STRIDE = 256, 224
SAMPLE_DOCS, OF_DOCUMENT, MADE = 1000, 4, 4000
#: Characters of a training window.
SEEN = 72
HIDDEN, STEPS, BATCH, RATE, LEAK = 12, 400, 48, 0.03, 0.05
CONFIDENCE = 0.95
#: Characters on either side of a span that its probability takes in.
AROUND = 48
#: Windows read at a time, runs decoded at a time, characters of scores held, characters of a run.
DECODED, TOGETHER, HELD, LONGEST = 1024, 128, 1 << 20, 1 << 14

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
#: The same as the base patterns' parts, for passes that stay linear on very long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rf"(?<![0-9]){IP.pattern}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """What EMAIL finds: an address ends in a domain after its at sign, and its name is all that can precede that."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end, 0
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed; code points, end exclusive."""
    found = []
    found += _emails(text)
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))]


# --- the model -------------------------------------------------------------------------------------------------------

SYMBOLS = 100


def encode(text: str) -> np.ndarray:
    """Symbols: ASCII as such, one each for other letters, other signs and line ends; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points < 127, points - 31, 97).astype(np.uint8)
    out[(points >= 0xC0) & (points < 0x2000)] = 96
    out[points < 32] = 98
    return out


def _cells(wx: np.ndarray, wh: np.ndarray, x: np.ndarray, keep: bool = False):
    """States (2, HIDDEN, T, B) of both directions over symbols (T, B), and what the way back needs.

    Gates are clipped to [0, 1], values and cells to [-1, 1]: piecewise linear, so that every character of every text can be
    read. ``wx`` is (2, 4 * HIDDEN, SYMBOLS), ``wh`` (2, 4 * HIDDEN, HIDDEN); the second direction reads backwards.
    """
    t, b = x.shape
    n = wh.shape[2]
    h, c = np.zeros((2, n, b), wx.dtype), np.zeros((2, n, b), wx.dtype)
    states, z, given, part = np.empty((2, n, t, b), wx.dtype), np.empty((2, 4 * n, b), wx.dtype), np.empty((2, 4 * n, b), wx.dtype), np.empty((2, n, b), wx.dtype)
    trail = []
    for k in range(t):
        np.take(wx[0], x[k], axis=1, out=given[0], mode="clip")
        np.take(wx[1], x[t - 1 - k], axis=1, out=given[1], mode="clip")
        np.matmul(wh, h, out=z)
        z += given
        gates, value = z[:, : 3 * n], z[:, 3 * n :]
        if keep:
            raw, before = z.copy(), (h.copy(), c.copy())
        np.clip(gates, 0, 1, out=gates)
        np.clip(value, -1, 1, out=value)
        c *= z[:, n : 2 * n]
        np.multiply(z[:, :n], value, out=part)
        c += part
        if keep:
            trail.append((raw, z.copy(), *before, c.copy()))
        np.clip(c, -1, 1, out=c)
        np.multiply(z[:, 2 * n : 3 * n], c, out=h)
        states[0, :, k], states[1, :, t - 1 - k] = h[0], h[1]
    return states, trail


def _slope(raw: np.ndarray, low: float) -> np.ndarray:
    """Slope of a clipped value; a little is left beyond the ends, so that no cell stays shut."""
    return np.where((raw >= low) & (raw <= 1), 1.0, LEAK)


def _cells_back(wh: np.ndarray, x: np.ndarray, trail: list, d_states: np.ndarray):
    """Gradients of wx and wh for those of the states."""
    t = len(x)
    n = wh.shape[2]
    d_wx, d_wh = np.zeros((2, SYMBOLS, 4 * n)), np.zeros_like(wh)
    dh, dc = np.zeros_like(d_states[:, :, 0]), np.zeros_like(d_states[:, :, 0])
    for k in reversed(range(t)):
        raw, z, h0, c0, c = trail[k]
        i, f, o, g = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
        dh = dh + np.stack([d_states[0, :, k], d_states[1, :, t - 1 - k]])
        dc = (dc + dh * o) * _slope(c, -1)
        dz = np.concatenate([dc * g, dc * c0, dh * np.clip(c, -1, 1), dc * i], 1)
        dz[:, : 3 * n] *= _slope(raw[:, : 3 * n], 0)
        dz[:, 3 * n :] *= _slope(raw[:, 3 * n :], -1)
        for d, at in ((0, k), (1, t - 1 - k)):
            np.add.at(d_wx[d], x[at], dz[d].T)
        d_wh += dz @ h0.transpose(0, 2, 1)
        dh, dc = wh.transpose(0, 2, 1) @ dz, dc * f
    return d_wx.transpose(0, 2, 1), d_wh


def _grammar() -> np.ndarray:
    """Allowed steps between labels: an inside label follows its own kind only."""
    ok = np.zeros((TAGS + 1, TAGS))  # the last row is the start
    for k in range(len(KINDS)):
        inside = 2 * k + 2
        ok[:, inside] = -1e4
        ok[[inside - 1, inside], inside] = 0
    return ok


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _marginals(scores: np.ndarray, steps: np.ndarray):
    """Forward-backward over (T, B, TAGS): label probabilities, and forward, backward and total scores."""
    t = len(scores)
    fore, back = np.zeros_like(scores), np.zeros_like(scores)
    fore[0] = scores[0] + steps[-1]
    for k in range(1, t):
        fore[k] = scores[k] + _log_sum(fore[k - 1][:, :, None] + steps[None, :-1], 1)
    for k in range(t - 2, -1, -1):
        back[k] = _log_sum(steps[None, :-1] + (scores[k + 1] + back[k + 1])[:, None, :], 2)
    total = _log_sum(fore[-1], 1)
    return np.exp(fore + back - total[None, :, None]), fore, back, total


def emissions(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores (TAGS, T, B) of the labels at each character of symbols (T, B)."""
    states = _cells(model["wx"], model["wh"], x)[0]
    t, b = x.shape
    return (model["out"].T @ states.reshape(-1, t * b) + model["bias"][:, None]).reshape(TAGS, t, b)


def train(windows: np.ndarray, labels: np.ndarray, seed: int = 7, steps: int = STEPS) -> dict:
    """Adam on the CRF's negative log likelihood; ``windows`` and ``labels`` are (N, T)."""
    r = np.random.default_rng(seed)
    make = lambda *s: r.standard_normal(s) * 0.15
    model = {"wx": make(2, 4 * HIDDEN, SYMBOLS), "wh": make(2, 4 * HIDDEN, HIDDEN), "out": make(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "steps": make(TAGS + 1, TAGS)}
    model["wx"][:, : 3 * HIDDEN] += 0.5
    model["wx"][:, HIDDEN : 2 * HIDDEN] += 0.3  # cells remember at first
    grammar = _grammar()
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = r.integers(0, len(windows), BATCH)
        x, y = windows[pick].T.astype(np.int64), labels[pick].T
        states, trail = _cells(model["wx"], model["wh"], x, True)
        t = len(x)
        both = states.reshape(2 * HIDDEN, t, BATCH).transpose(1, 2, 0)
        scores = both @ model["out"] + model["bias"]
        moves = model["steps"] + grammar
        p, fore, back, total = _marginals(scores, moves)
        d_scores = p.copy()
        d_scores[np.arange(t)[:, None], np.arange(BATCH), y] -= 1
        pairs = np.exp(fore[:-1, :, :, None] + moves[None, None, :-1] + (scores[1:] + back[1:])[:, :, None, :] - total[None, :, None, None]).sum((0, 1))
        d_moves = np.vstack([pairs, p[0].sum(0)])
        np.add.at(d_moves, (y[:-1].ravel(), y[1:].ravel()), -1)
        np.add.at(d_moves, (TAGS, y[0]), -1)
        d_both = (d_scores @ model["out"].T).transpose(2, 0, 1).reshape(2, HIDDEN, t, BATCH)
        grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, TAGS), "bias": d_scores.sum((0, 1)), "steps": d_moves}
        grads["wx"], grads["wh"] = _cells_back(model["wh"], x, trail, d_both)
        norm = np.sqrt(sum((g**2).sum() for g in grads.values())) / BATCH
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))  # falls to nothing over the second half
        for k, g in grads.items():
            g = g / BATCH / max(1.0, norm / 5)
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.01 * (g * g - m2[k])
            model[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return settled(model, model["steps"] + grammar)


def settled(model: dict, moves: np.ndarray) -> dict:
    """The trained model in single precision, and what ``restless`` needs: each kind's steps into, within and out of a span
    and straight from one span to another, less the step from outside to outside that is left out for it."""
    out = {k: v.astype(np.float32) for k, v in model.items()} | {"steps": moves.astype(np.float32)}
    rest, began = moves[0, 0], moves[-1, 0]
    begin, inside = 2 * np.arange(len(KINDS)) + 1, 2 * np.arange(len(KINDS)) + 2
    gains = [
        np.maximum(moves[0, begin] - rest, moves[-1, begin] - began), np.maximum(moves[begin, inside], moves[inside, inside]) - rest,
        np.maximum(moves[begin, 0], moves[inside, 0]) - rest, moves[1:-1][:, begin].max(0) - rest,
    ]
    out["gains"] = np.array(gains, np.float32)[:, :, None]
    return out


def restless(model: dict, scores: np.ndarray) -> np.ndarray:
    """(B): windows in whose scores (TAGS, T, B) the best path may leave "outside".

    Against the path that stays outside, a span wins its labels' lead and its own steps, and loses the steps from outside to
    outside that it leaves out. ``won`` is the most that a span of each kind can win that ends here, on top of what spans
    straight before it won. Where it never exceeds 0 with the step out, no path is better than the one outside.
    """
    into, within, out, across = model["gains"]
    begin, inside = scores[1::2] - scores[0], scores[2::2] - scores[0]
    won = np.full(begin[:, 0].shape, -1e9, np.float32)
    found = np.zeros(scores.shape[2], bool)
    for t in range(scores.shape[1]):
        entered = np.maximum(won.max(0) + across, into)
        won += inside[:, t]
        won += within
        entered += begin[:, t]
        np.maximum(won, entered, out=won)
        found |= (won + out).max(0) > 0
    return found | (won.max(0) > 0)  # a span may go on to the end


def best_path(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Labels (T, B) of the best path over scores (T, B, TAGS)."""
    t = len(scores)
    best, came = scores[0] + moves[-1], np.zeros(scores.shape, np.uint8)
    for k in range(1, t):
        through = best[:, :, None] + moves[None, :-1]
        came[k] = through.argmax(1)
        best = scores[k] + through.max(1)
    tags = np.zeros(scores.shape[:2], np.int64)
    tags[-1] = best.argmax(1)
    for k in range(t - 1, 0, -1):
        tags[k - 1] = np.take_along_axis(came[k], tags[k][:, None], 1)[:, 0]
    return tags


# --- labelled spans --------------------------------------------------------------------------------------------------


def labels_of(spans: list[tuple[int, int, str]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, b, kind in spans:
        if not out[a:b].any():
            out[a], out[a + 1 : b] = 2 * KINDS.index(kind) + 1, 2 * KINDS.index(kind) + 2
    return out


class Maker:
    """Entities as people write them, and numbers and words that are none."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, *of):
        return of[int(self.r.integers(len(of)))]

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.one(*first) + "".join(map(str, self.r.integers(0, 10, n - 1).tolist()))

    def word(self, low: int = 2, high: int = 9) -> str:
        letters = "aabcdeefghiijklmnnoopqrrsstuvwxyz"
        return "".join([letters[k] for k in self.r.integers(0, len(letters), int(self.r.integers(low, high + 1))).tolist()])

    def email(self) -> str:
        user, host = self.one(self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.digits(2)}", f"{self.word()}_{self.word()}"), self.word(3, 10)
        end = self.one("com", "org", "net", "de", "fr", "es", "co", "io", "edu")
        at, dot = self.one((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" AT ", " DOT "), (" at ", " dot "), (" @ ", " . "), ("@", " dot "), ("@", "."), ("@", "[.]"))
        return user + at + host + self.one("", "", dot + self.word(2, 6)) + dot + end

    def ip(self) -> str:
        return self.one(" dot ", "[.]", " . ", "(.)", ".", "[dot]").join(str(x) for x in self.r.integers(0, 256, 4))

    def card(self) -> str:
        body = self.digits(15, "3456")
        body += next(d for d in "0123456789" if luhn(body + d))
        return self.one(".", "_", "/", "  ", "", " ", "-", ".", "_").join(body[k : k + 4] for k in range(0, 16, 4))

    def phone(self) -> str:
        d = self.digits
        return self.one(
            f"({d(3)}) {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3, '23456789')}-{d(3)}-{d(4)}", f"{d(3, '23456789')}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"0{d(3)}-{d(6)}", f"0{d(4)}/{d(5)}",
            f"00{d(2, '123456789')} {d(2)} {d(4)} {d(4)}", f"{d(3, '23456789')} {d(3)} {d(4)}", f"+{d(2, '123456789')} {d(3)} {d(3)} {d(4)}", f"+{d(1, '123456789')} ({d(3)}) {d(3)}-{d(4)}",
        )

    def none(self) -> str:
        d = self.digits
        wrong = d(15, "3456")
        wrong += next(x for x in "0123456789" if not luhn(wrong + x))
        return self.one(
            f"20{d(2)}-0{d(1, '123456789')}-1{d(1)}", f"1{d(1)}/0{d(1)}/20{d(2)}", f"1{d(1)}.0{d(1)}.19{d(2)}", f"{d(2, '12')}:{d(2, '012345')}", f"{d(1)}.{d(1)}.{d(2)}", f"v{d(1)}.{d(2)}", f"{d(2)},{d(3)}", f"{d(3)}.{d(2)}", f"${d(4, '123')}", f"{d(2)}%", d(5), d(7), d(9), d(13),
            f"#{d(6)}", f"19{d(2)}-20{d(2)}", f"{d(3)}-{d(3)}", wrong, "-".join(wrong[k : k + 4] for k in range(0, 16, 4)), f"{d(3, '3456789')}.{d(3)}.{d(3)}.{d(3)}", self.r.bytes(9).hex(), f"{self.word()} at {self.word()}", f"at {d(2)} dot", f"the dot at the {self.word()}",
            f"{self.word()} dot {self.word()}", f"@{self.word()}", f"{self.word()} @ {d(2)}", f"sk_{self.r.bytes(8).hex()}", f"{d(1)} {d(2)} {d(3)} {d(2)}", f"({d(4, '12')})", f"[{d(2)}]", f"{d(4)} {d(4)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(5)}-{d(4)}",
        )

    def example(self, carrier: str = "") -> tuple[str, list[tuple[int, int, str]]]:
        """A line with an entity, or with what is none, put between the words of ``carrier`` or of made-up words."""
        kind = self.one(*KINDS, *KINDS, "none", "none", "none")
        entity = getattr(self, kind)()
        words = carrier.split(" ") if carrier else [self.word() for _ in range(int(self.r.integers(0, 14)))]
        at = int(self.r.integers(0, len(words) + 1))
        before, after = " ".join(words[:at]), " ".join(words[at:])
        start = len(before) + bool(before)
        text = before + " " * bool(before) + entity + self.one("", "", ".", ",", ")", ";", "\n") + " " * bool(after) + after
        return text, [(start, start + len(entity), kind)] if kind != "none" else []


def window_of(text: str, spans: list[tuple[int, int, str]], at: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of the ``SEEN`` characters from ``at`` on."""
    x, y = np.zeros(SEEN, np.uint8), np.zeros(SEEN, np.int64)
    own = encode(text[at : at + SEEN])
    labels = labels_of(spans, len(text))[at : at + SEEN]
    x[: len(own)], y[: len(labels)] = own, labels
    if len(labels) and labels[0] and labels[0] % 2 == 0:  # cut entity: an inside label can't begin a window
        y[0] = labels[0] - 1
    return x, y


def made_windows(n: int, seed: int, carriers: list[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows with made-up entities, half of them in ``carriers``, if there are any."""
    maker = Maker(seed)
    out = []
    for k in range(n):
        carrier = carriers[int(maker.r.integers(len(carriers)))] if len(carriers) and k % 2 else ""
        text, spans = maker.example(carrier[: SEEN // 2])
        out.append(window_of(text, spans, max(0, (spans[0][0] if spans else 0) - int(maker.r.integers(0, SEEN - 8)))))
    return tuple(np.array(x) for x in zip(*out, strict=True))


def sampled_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of at most ``sample_docs`` documents, the first in the order of hashed ids, cut on the executors: up to
    ``OF_DOCUMENT`` a document, chosen by hash, half around digits and at signs, with the base spans as labels. Also pieces
    of their text, as carriers of made-up entities. So many windows reach the driver, however long the documents are."""
    keyed = docs.where("length(text) > 0").select(F.xxhash64("doc_id").alias("h"), "text")
    last = keyed.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros((0, SEEN), np.uint8), np.zeros((0, SEEN), np.int64), []

    def cut(batches):
        for batch in batches:
            rows = []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                r = np.random.default_rng(h & 0xFFFFFFFF)
                spans = base_spans(text)
                near = [m.start() for m in _TRIGGER.finditer(text)]
                starts = [max(0, near[int(k)] - int(r.integers(0, SEEN))) for k in r.integers(0, len(near), OF_DOCUMENT // 2)] if near else []
                starts += [int(k) for k in r.integers(0, len(text), OF_DOCUMENT - len(starts))]
                for at in sorted({*starts}):
                    x, y = window_of(text, spans, at)
                    rows.append((h, x.tobytes(), y.astype(np.uint8).tobytes(), text[at : at + SEEN // 2]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.binary(), pa.string()], strict=True)], ["h", "x", "y", "piece"])

    rows = map_batches(keyed.where(F.col("h") <= last), cut, "h long, x binary, y binary, piece string").orderBy("h", "x", "y").limit(sample_docs * OF_DOCUMENT).collect()
    x = np.array([np.frombuffer(r["x"], np.uint8) for r in rows]).reshape(-1, SEEN)
    y = np.array([np.frombuffer(r["y"], np.uint8) for r in rows]).reshape(-1, SEEN).astype(np.int64)
    return x, y, [r["piece"] for r in rows if not _TRIGGER.search(r["piece"])]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 7) -> dict:
    """Train on windows of a bounded sample of documents and as many (``MADE`` at least) with made-up entities."""
    x, y, carriers = sampled_windows(docs, sample_docs)
    made_x, made_y = made_windows(max(MADE, len(x)), seed, carriers)
    return train(np.concatenate([x, made_x]), np.concatenate([y, made_y]), seed)


# --- whole texts -----------------------------------------------------------------------------------------------------


def _starts(n: int) -> np.ndarray:
    """Starts of a text's windows; the last one holds its end."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _plausible(kind: str, span: str, around: str) -> bool:
    """What holds for an entity of the kind however it is written; numbers that the base rule refuses stay refused."""
    numbers = re.findall(r"[0-9]+", span)
    digits = "".join(numbers)
    if span[0].isspace() or span[-1].isspace() or around[0].isalnum() and span[0].isalnum() or around[1:].isalnum() and span[-1].isalnum():
        return False
    if kind == "email":
        named = span[0].isalnum() and span[-1].isalnum() and not re.search(r"\b(dot|at)$", span, re.I)
        return len(span) >= 7 and named and bool(re.search(r".(@|\bat\b).*.(\.|\bdot\b)", span, re.I | re.S))
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return (9 if "+" in span else 7) <= len(digits) <= 15


def added_spans(model: dict, texts: list[str], base: list[list[tuple[int, int, str]]], confidence: float = CONFIDENCE) -> list[list[tuple[int, int, str]]]:
    """What the model adds to ``base`` in each text. Every window of every text is read."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = [_starts(n) for n in sizes.tolist()]
    flat = np.zeros(int((sizes + WINDOW).sum()), np.uint8)
    begin = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    for b, t in zip(begin.tolist(), texts, strict=True):
        flat[b : b + len(t)] = encode(t)
    of = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
    at = np.concatenate([np.zeros(0, np.int64), *windows])
    span = np.arange(WINDOW)[:, None]
    read = lambda rows: emissions(model, flat[(begin[of[rows]] + at[rows])[None, :] + span])
    # the part of each window that counts: up to the middle of its overlaps
    half = (WINDOW - STRIDE) // 2
    first, last = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool), np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    low, high = np.where(first, 0, at + half), np.where(last, sizes[of], at + half + STRIDE)
    live = np.zeros(len(of), bool)
    for k in range(0, len(of), DECODED):
        rows = np.arange(k, min(len(of), k + DECODED))
        live[rows] = restless(model, read(rows))
    # neighbours come along, as a span may reach into them
    near = live.copy()
    near[1:] |= live[:-1] & (of[1:] == of[:-1])
    near[:-1] |= live[1:] & (of[1:] == of[:-1])
    wanted = np.flatnonzero(near)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    pieces: list[tuple[int, int, np.ndarray]] = []  # text, start, scores of a run of windows, whole
    for k in range(0, len(wanted), DECODED):
        rows = wanted[k : k + DECODED]
        scores = read(rows).transpose(2, 1, 0)
        for j, w in enumerate(rows.tolist()):
            own = scores[j, low[w] - at[w] : high[w] - at[w]]
            if pieces and pieces[-1][0] == of[w] and pieces[-1][1] + len(pieces[-1][2]) == low[w] and len(pieces[-1][2]) < LONGEST:
                pieces[-1] = (*pieces[-1][:2], np.concatenate([pieces[-1][2], own]))
            elif pieces and pieces[-1][0] == of[w] and pieces[-1][1] + len(pieces[-1][2]) == low[w]:
                # a very long run is cut where "outside" leads most, in its last window
                d, start, so_far = pieces[-1]
                lead = so_far[-STRIDE:, 1:].max(1) - so_far[-STRIDE:, 0]
                cut = len(so_far) - min(STRIDE, len(so_far)) + int(lead.argmin())
                pieces[-1] = (d, start, so_far[: cut + 1])
                pieces.append((d, start + cut + 1, np.concatenate([so_far[cut + 1 :], own])))
            else:
                pieces.append((int(of[w]), int(low[w]), own.copy()))
        if sum(len(p[2]) for p in pieces) > HELD:
            _decode(model, texts, base, pieces[:-1], confidence, out)
            del pieces[:-1]
    _decode(model, texts, base, pieces, confidence, out)
    return out


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    """Scores (T, B, TAGS) of several sequences; beyond a shorter one's end it is outside."""
    out = np.full((max(map(len, parts)), len(parts), TAGS), -50, np.float32)
    out[:, :, 0] = 50
    for j, s in enumerate(parts):
        out[: len(s), j] = s
    return out


def _decode(model: dict, texts: list[str], base: list, pieces: list[tuple[int, int, np.ndarray]], confidence: float, out: list) -> None:
    """Decode runs of windows, each as one sequence, and add the spans that hold to ``out``. A span's probability is that of
    its labels within the ``AROUND`` characters on either side."""
    pieces = sorted(pieces, key=lambda p: len(p[2]))
    for k in range(0, len(pieces), TOGETHER):
        some = pieces[k : k + TOGETHER]
        tags = best_path(_padded([s for *_, s in some]), model["steps"])
        spans = []
        for j, (d, start, s) in enumerate(some):
            tag = tags[: len(s), j]
            for a in np.flatnonzero(tag % 2 == 1).tolist():
                kind, b = int(tag[a] - 1) // 2, a + 1
                while b < len(tag) and tag[b] == 2 * kind + 2:
                    b += 1
                x, y, text = start + a, start + b, texts[d]
                if _plausible(KINDS[kind], text[x:y], (text[x - 1] if x else " ") + text[y : y + 1]) and not any(u < y and x < v for u, v, _ in base[d]):
                    spans.append((d, x, y, kind, s[max(0, a - AROUND) : b + AROUND], tag[a:b], min(a, AROUND)))
        for at in range(0, len(spans), TOGETHER):
            part = spans[at : at + TOGETHER]
            p = _marginals(_padded([x[4] for x in part]).astype(np.float64), model["steps"].astype(np.float64))[0]
            for row, (d, x, y, kind, _, tag, a) in enumerate(part):
                if p[np.arange(a, a + len(tag)), row, tag].mean() >= confidence:
                    out[d].append((x, y, KINDS[kind]))


def _order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, or run of overlapping spans, becomes its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


#: Columns of ``find``.
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find(docs: DataFrame, model: dict | None = None, texts: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, counts of base spans by kind, base_sha256, spans (base and added).

    With ``texts``, also ``redacted``: the text with every span replaced. A null text counts as empty; null doc_ids and
    rows that repeat one are kept; other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs) if model is None else model

    def run(batches):
        for batch in batches:
            whole = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in whole]
            every = [_order(a + b) for a, b in zip(base, added_spans(model, whole, base), strict=True)]
            columns = [pa.array([sum(k == kind for *_, k in s) for s in base], pa.int64()) for kind in KINDS]
            digest = pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base])
            clean = pa.array([redact(t, s) if texts else None for t, s in zip(whole, every, strict=True)], pa.string())
            yield pa.record_batch([batch.column("doc_id"), *columns, digest, pa.array([_joined(s) for s in every]), clean], [x.split()[0] for x in SCHEMA.split(", ")])

    out = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
    return out if texts else out.drop("redacted")


def redact_documents(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced and n_chars recounted; a null text stays null."""
    model = fit(docs) if model is None else model

    def run(batches):
        for batch in batches:
            given = batch.column("text").to_pylist()
            whole = [t or "" for t in given]
            base = [base_spans(t) for t in whole]
            added = added_spans(model, whole, base)
            clean = [None if g is None else redact(t, _order(a + b)) for g, t, a, b in zip(given, whole, base, added, strict=True)]
            new = {"text": pa.array(clean, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in clean], pa.int64())}
            yield pa.record_batch([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    fields = ", ".join(f"`{f.name}` {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, fields)
