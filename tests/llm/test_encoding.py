import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankflow.llm.encoding import ByteEncoder, WordEncoder, encode_decode

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "A", "é", "漢", "!?", "..", "12", "\x1c", "\x85", "<|endoftext|>", "Σ", "́", "İ", "ẞ", "the", "ing"]


@pytest.fixture(scope="module")
def byte():
    return ByteEncoder(BYTE)


@pytest.fixture(scope="module")
def word():
    return WordEncoder(WORD)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(max_size=40)))
def test_equal_to_the_library(text):
    byte, word = _both()
    ids = byte.encode(text)
    assert ids == byte.tokenizer.encode(text, add_special_tokens=False).ids
    assert byte.decode_bytes(ids).decode() == byte.tokenizer.decode(ids, skip_special_tokens=False) == text
    assert list(word.encode(text)) == word.tokenizer.encode(text, add_special_tokens=False).ids


_KEPT = []


def _both():
    if not _KEPT:
        _KEPT.extend((ByteEncoder(BYTE), WordEncoder(WORD)))
    return _KEPT


@pytest.mark.parametrize("leaf", [3, 16, 64])
def test_tree_of_long_unsplit_text(leaf):
    byte, rng = ByteEncoder(BYTE, leaf=leaf), random.Random(leaf)
    for parts in (["a", "aa", "b"], ["the", "ing", "er", "é", "漢"], ["-", "=", "--"], ["0", "12", "x"], ["the", "ing", "<|endoftext|>"]):
        for _ in range(15):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(150, 700)))
            assert byte.encode(text) == byte.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded(word):
    small = WordEncoder(WORD, cache_entries=3)
    texts = ["one two three four five", "漢字 six seven", "one two"]
    assert [list(small.encode(t)) for t in texts] == [list(word.encode(t)) for t in texts]
    assert len(small.parts) <= 5


def test_rows(spark):
    texts = [None, "", "Hello world", "Hello world", "x" * 20000, "tail  \n"]
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = sorted(encode_decode(docs, BYTE).collect(), key=lambda r: r.doc_id or 0)
    library = ByteEncoder(BYTE).tokenizer
    for r, t in zip(rows, texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, t or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_decode(docs.limit(0), BYTE).count() == 0


def test_every_plain_character(word):
    """Alone, doubled, between letters and after digits, each character of the plain range encodes as in the library."""
    for k in (*range(0x20, 0x7F), *range(0xA1, 0x250)):
        text = f"{chr(k)} {chr(k)}{chr(k)} a{chr(k)}b 1{chr(k)}2 '{chr(k)}"
        assert list(word.encode(text)) == word.tokenizer.encode(text, add_special_tokens=False).ids, hex(k)
