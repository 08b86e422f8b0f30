from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlode.llm.tokens import Chunker, vocabulary_path

CODERS = {n: Chunker(vocabulary_path(n), n.startswith("byte")) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
PIECES = [" ", "  ", "\n", "\n\n", "\n ", " \n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "a", "the", "É", "é", "é", "ß", "µ", "ñ", "'s", "'", "'LL", "12", "3", ".", "!!", "$%", "<|endoftext|>", "<|startoftext|>", "日本", "İ", "Σ", "\x01", "\x02", "‍", "😀", "x" * 60]


@pytest.mark.parametrize("name", CODERS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.text(max_size=20)), max_size=8))
def test_ids_are_the_librarys(name, texts):
    coder = CODERS[name]
    flat, counts = coder.batch(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        expected = coder.whole(text)
        assert list(flat[at : at + n]) == expected
        assert list(coder.ids(text)) == expected
        at += n
    assert at == len(flat)


def test_null_counts_as_empty_and_memory_starts_anew(monkeypatch):
    from threadlode.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 600)
    coder = Chunker(vocabulary_path("byte_bpe_50k.json"), True)
    texts = ["one two three", None, "", "four five six seven", "one two"]
    for _ in range(6):
        flat, counts = coder.batch(pa.array(texts, pa.string()))
        assert list(flat) == [x for t in texts for x in coder.whole(t or "")]
        assert counts[1] == counts[2] == 0
        assert coder.bytes <= 600 + 200


@pytest.mark.parametrize("name", CODERS)
def test_memory_is_bounded_in_bytes(name, monkeypatch):
    """Long chunks are never kept, others from their second batch on and within the bound."""
    import sys

    from threadlode.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 1 << 20)
    coder = Chunker(vocabulary_path(name), name.startswith("byte"))
    for k in range(12):
        words = [f"w{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676 % 26)}{'xyz'[k // 4]}" for j in range(9000)]
        coder.batch(pa.array([" ".join(words), "z" * 200_000, "q" * 49, "once" + "abcdefghijkl"[k]], pa.string()))
        held = sys.getsizeof(coder.number) + sum(map(sys.getsizeof, coder.number)) + 32 * len(coder.number) + sum(sys.getsizeof(x) for x in (coder.pool, coder.starts, coder.sizes))
        assert held < 1.5 * (1 << 20) and coder.bytes <= (1 << 20) + 400
        assert max(map(len, coder.number), default=0) <= tokens.CACHE_CHARS
        assert not any(c.strip().startswith("once") and len(c) > 6 for c in coder.number)
    assert coder.number
