import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kgspark.llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.Counter(PATH)
PARTS = st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "aaaaaaa", "'ve", "'RE", "!!!!", "  ", "Σς", "İ", "\x1c", " ", "é", "가", "١٢"])), max_size=8)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_counts_are_the_librarys(parts):
    text = "".join(parts)
    assert COUNTER.count([text])[0] == count(text)


@pytest.mark.parametrize("context", ["{}", "a{}b", "\u00ba{}", "9 {}A\u0301"])
def test_every_code_point(context):
    """Alone, between letters, after a letter without case, between marks and digits, before a combining mark."""
    texts = [context.format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 1 << 17):
        part = texts[at : at + (1 << 17)]
        want = np.array([len(e.ids) for e in LIBRARY.encode_batch(part, add_special_tokens=False)])
        wrong = np.flatnonzero(COUNTER.count(part) != want)
        assert not len(wrong), [part[i] for i in wrong[:5]]


def test_fuzzed_texts():
    r = random.Random(6)
    ranges = [(32, 127), (0xA0, 0x250), (0x300, 0x600), (0x1C80, 0x2100), (0x3040, 0x3100), (0xAC00, 0xAE00), (0x10900, 0x10A00), (0x18E00, 0x19000), (0x1F600, 0x1F700), (0x32300, 0x33480), (9, 33)]
    texts = ["".join(chr(r.randrange(*r.choice(ranges))) if r.random() < 0.9 else r.choice(["'s", "<|endoftext|>", "<|endoftext", "\u03a3", " "]) for _ in range(r.randint(0, 40))) for _ in range(10_000)]
    assert COUNTER.count(texts).tolist() == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_very_long_words():
    for text in ("x" * 200_000, "\u00e9" * 100_000, "ab" * 100_000, "!" * 50_000, "7" * 50_000, " " * 300_000 + "a"):
        assert COUNTER.count([text])[0] == count(text)


def test_table(odd, local):
    got = Counter(tuple(r) for r in tokens.count_tokens(odd, PATH).collect())
    assert got == Counter((r["doc_id"], len((r["text"] or "").encode()), (n := count(r["text"] or "")), n > 2048) for r in local)


def test_empty_table(none):
    assert tokens.count_tokens(none, PATH).collect() == []


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    c = tokens.Counter(PATH)
    texts = [f"word{i} other{i}" for i in range(50)]
    assert [c.count([t])[0] for t in texts] == [count(t) for t in texts]
    assert len(c.known) <= 12
