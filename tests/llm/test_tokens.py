"""The encoders beside the tokenizers' own results."""

import random

import pytest

from tactus.llm import tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizer(name):
    e = tokens.encoder(open(tokens.vocabulary_path(name)).read())
    parts = ["word", "Word,", "it's", "it',", "'s", "s'", ",", "a.", "a..", "x1,", "12", "é,", "naïve", "日本", "<|endoftext|>", "a-b;", "A!", "?b", "_", "a\x00", ":", ""]
    r = random.Random(3)
    texts = ["", " ", "\n", " a", "a ", "a  b", "a\t b"] + ["".join(r.choice(parts) + r.choice([" ", " ", " ", "\n", "  "]) for _ in range(r.randint(1, 30))) for _ in range(500)]
    got = e.encode([t.encode() for t in texts])
    assert [t for t, ids in zip(texts, got, strict=True) if ids != e.whole(t)] == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.ByteEncoder(open(tokens.vocabulary_path("byte_bpe_50k.json")).read())
    text = "one two, three four; five one two, six seven. one"
    assert e.encode([text.encode()] * 3) == [e.whole(text)] * 3


def test_a_batch_encodes_each_chunk_once(monkeypatch):
    """Also where memory is far too small for its different words, and for words with different marks after them."""
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    made = []
    of_piece = tokens.ByteEncoder.of_piece
    monkeypatch.setattr(tokens.ByteEncoder, "of_piece", lambda self, piece: (made.append(piece), of_piece(self, piece))[1])
    e = tokens.ByteEncoder(open(tokens.vocabulary_path("byte_bpe_50k.json")).read())
    words = [f"w{'abcdefghij'[i]}x" for i in range(10)]
    texts = [" ".join(w + m for w in words) for m in ["", ",", ".", ";", "?"]]
    assert e.encode([t.encode() for t in texts]) == [e.whole(t) for t in texts]
    assert len(made) == len(set(made)) <= 10 + 1 + 4


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_in_parts_of_any_signs(name, monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    e = tokens.encoder(open(tokens.vocabulary_path(name)).read())
    r = random.Random(5)
    signs = [chr(c) for c in range(32, 127)] * 2 + list("'''   \n\nsStTéÉßſİΣσ日́ \x7f 😀")
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    got = [x for i in range(0, 2000, 100) for x in e.encode([t.encode() for t in texts[i : i + 100]])]
    assert [t for t, ids in zip(texts, got, strict=True) if ids != e.whole(t)] == []
    assert e.encode([]) == [] and e.encode([b""] * 2) == [b""] * 2
