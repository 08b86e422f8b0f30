"""Tokenizing whole texts with the tokenizers library, one distinct word at a time.

The library spends most of its time on normalizing and splitting. A corpus repeats its words, so here Arrow's kernels
split whole batches by the vocabulary's own pattern, each distinct word is given to the library's model once, and
everything else is looked up. The ids are the library's own wherever a chunk's ids can't depend on its neighbours; any
other text or chunk is encoded whole. ``tests/llm/test_tokens.py`` holds all ways against each other.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a worker's memory of chunks may take; beyond it the memory is started anew.
CACHE_BYTES = 24 << 20
#: What an entry takes besides its characters and ids: string, number, their places in the table and two offsets.
ENTRY_BYTES = 160
#: Chunks longer than this are encoded but not remembered.
CACHE_CHARS = 48
#: Marks of chunks met before; a chunk is remembered from its second batch on, as most chunks occur only once.
MARKS = 1 << 20
#: Text that is tokenized at a time; what a batch takes besides is some 20 times that.
TOKEN_BYTES = 2 << 20

#: Letters for which the short way is taken; chunks with characters outside ASCII and these go to the library whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\n\x20-\x7e{_LETTERS}]*")
#: The split patterns of the two vocabularies, for the characters above.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_DROP_SPACE = re.compile(rf"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_KEEP_SPACE = re.compile(rf"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
#: White space on both sides of a cut, or a cut at the end of the text.
_DIVIDED = re.compile(r"[\s\x1c-\x1f] | [\s\x1c-\x1f]| \Z")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class Chunker:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` as an int32 array.

    ``keep_space=False``: for the word vocabulary, which lower-cases and drops white space. ``keep_space=True``: for
    the byte vocabulary, where a space belongs to the word after it; texts are cut before single spaces, and those
    with runs of white space that a cut would divide are encoded whole, as are texts with a special token's string.
    """

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.model = self.tokenizer.model
        self.keep_space = keep_space
        self.pattern = _KEEP_SPACE if keep_space else _DROP_SPACE
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.starts, self.sizes = array("i"), array("q"), array("q")
        self.bytes, self.met = 0, bytearray(MARKS)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        if word.isascii():
            text = "\u0120" + word[1:] if word[0] == " " else word
        else:
            text = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(text)]

    def _chunk(self, chunk: str) -> list[int]:
        letters = chunk[1:] if self.keep_space and chunk[:1] == " " else chunk
        if letters.isalpha() and (chunk.isascii() or max(chunk) <= "ÿ") and (self.keep_space or chunk.islower()):
            return self._word(chunk)
        if not _PLAIN.fullmatch(chunk):
            return self.whole(chunk)
        out: list[int] = []
        for word in self.pattern.findall(chunk if self.keep_space else chunk.lower()):
            out += [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        return out

    def _look_up(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each of the distinct ``chunks`` starts and how many ids it has."""
        if self.bytes > CACHE_BYTES:
            self._clear()
        at = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        pool, ends = array("i"), array("q", [0])
        for k in new.tolist():
            pool.extend(self._chunk(chunks[k]))
            ends.append(len(pool))
        known, edges = at >= 0, np.array(ends)
        starts, sizes = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        starts[known], sizes[known] = np.frombuffer(self.starts, np.int64)[at[known]], np.frombuffer(self.sizes, np.int64)[at[known]]
        starts[new], sizes[new] = edges[:-1] + len(self.pool), np.diff(edges)
        every = np.concatenate([np.frombuffer(self.pool, np.int32), np.frombuffer(pool, np.int32)])
        for k, a, b in zip(new.tolist(), ends, ends[1:], strict=False):
            self._remember(chunks[k], pool[a:b])
        return every, starts, sizes

    def _remember(self, chunk: str, ids: array) -> None:
        mark = hash(chunk) % MARKS
        if len(chunk) > CACHE_CHARS or self.bytes > CACHE_BYTES or not self.met[mark]:
            self.met[mark] = 1
            return
        self.number[chunk] = len(self.starts)
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids))
        self.pool.extend(ids)
        self.bytes += ENTRY_BYTES + 2 * len(chunk) + 4 * len(ids)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if any(s in text for s in self.special):
            return np.array(self.whole(text), np.int32)
        if self.keep_space:
            if _DIVIDED.search(text):
                return np.array(self.whole(text), np.int32)
            first, *rest = text.split(" ")
            chunks = [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]
        else:
            chunks = text.replace("\n", " ").split(" ")
        place = {c: k for k, c in enumerate(dict.fromkeys(chunks))}
        pool, starts, sizes = self._look_up(list(place))
        return _taken(pool, starts, sizes, np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks)))[0]

    def _prepared(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Lists of chunks for each text, and which texts have to be encoded one by one."""
        plain = pc.match_substring_regex(texts, r"^[\n\x20-\x7eÀ-ÖØ-öø-ÿ]*$")
        for mark in ("'", *self.special):
            plain = pc.and_not(plain, pc.match_substring(texts, mark))
        if not self.keep_space:
            short = pc.replace_substring_regex(pc.utf8_lower(texts), r"([^\s\p{L}0-9]+|[0-9])", r" \1 ")
            rest = np.zeros(len(texts), bool)
            for mark in self.special:
                rest |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            return pc.ascii_split_whitespace(pc.if_else(plain, short, texts)), rest
        plain = pc.and_not(plain, pc.match_substring_regex(texts, r"\s |  | \s| $|\n\n"))
        cut = pc.replace_substring_regex(texts, r"([^\s\p{L}0-9]+|[0-9]+|\n)", "\x01\\1\x01")
        for old in (" \x01", " "):  # a space goes with what follows it
            cut = pc.replace_substring(cut, old, "\x01\x02")
        return pc.split_pattern(pc.if_else(plain, cut, ""), "\x01"), ~plain.to_numpy(zero_copy_only=False)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and each text's number of ids; a null counts as an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists, alone = self._prepared(texts)
        coded = lists.flatten().dictionary_encode()
        chunks = pc.replace_substring(coded.dictionary, "\x02", " ").to_pylist() if self.keep_space else coded.dictionary.to_pylist()
        flat, ends = _taken(*self._look_up(chunks), coded.indices.to_numpy(zero_copy_only=False))
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        counts = np.diff(edges)
        if alone.any():
            own = {k: self.ids(texts[k].as_py()) for k in np.flatnonzero(alone)}
            flat = np.concatenate([own[k] if k in own else flat[edges[k] : edges[k + 1]] for k in range(len(texts))])
            for k, ids in own.items():
                counts[k] = len(ids)
        return flat, counts


def _taken(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunks ``at``, end to end, and where each chunk ends."""
    starts, sizes = starts[at], sizes[at]
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(n)] if n else np.zeros(0, np.int32), ends


@lru_cache(maxsize=1)
def worker_chunker(path: str, keep_space: bool) -> Chunker:
    """The worker's own coder: its memory of words, at most CACHE_BYTES, outlives a task, as Spark uses a worker for many."""
    return Chunker(path, keep_space)
