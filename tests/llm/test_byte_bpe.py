"""The sentencepiece form of a rank vocabulary beside the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tactus.llm import byte_bpe, tokens

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name):
    path = tokens.vocabulary_path(name)
    e, t = byte_bpe.RankEncoder(open(path).read()), library(path)
    parts = ["word", "Word,", "it's", "'s", ",", "a..", "12", "é,", "naïve", "日本語", "<|endoftext|>", "a-b;", "_", "a\x00", " ", "İ", "ſ", "👍🏽", "é", "supercalifragilistic", "=====", "ZZZZ9"]
    r = random.Random(5)
    texts = ["", " ", "\n", " a", "a ", "a  b", "a\t b", "\r\n\r\n x", "x" * 5000, "ab" * 3000, " " * 300 + "a"]
    texts += ["".join(r.choice(parts) + r.choice([" ", " ", "", "\n", "  ", " "]) for _ in range(r.randint(1, 30))) for _ in range(400)]
    texts += ["".join(chr(r.choice([r.randint(1, 127), r.randint(128, 0x2FF), r.randint(0x3040, 0x30FF), r.randint(0x1F300, 0x1F5FF)])) for _ in range(60)) for _ in range(200)]
    raw = [x.encode() for x in texts]
    got = [list(memoryview(x).cast("H")) for x in e.encode(raw)]
    assert [x for x, ids in zip(texts, got, strict=True) if ids != t.encode_ordinary(x)] == []
    assert [e.decode(x) for x in got] == raw


@pytest.mark.parametrize("name", FILES)
def test_every_piece_is_reached_by_merges(name):
    """The model alone, without the look-up of whole pieces, gives each piece its own id."""
    e = byte_bpe.RankEncoder(open(tokens.vocabulary_path(name)).read())
    mapped = [byte_bpe.as_characters(b) for b in e.bytes_of]
    lost = [i for i, ids in enumerate(e.processor.encode(mapped)) if ids != [i]]
    assert e.processor.get_piece_size() == len(mapped) + 1
    assert [i for i in lost if len(e.bytes_of[i]) == 1] == []
    t = library(tokens.vocabulary_path(name))
    assert all(list(memoryview(e.of_piece(e.bytes_of[i].decode())).cast("H")) == t.encode_ordinary(e.bytes_of[i].decode()) for i in lost if _is_text(e.bytes_of[i]))


def _is_text(b):
    try:
        return len(b.decode()) > 0
    except UnicodeDecodeError:
        return False


ROWS = [(1, "one two, three"), (1, "one two, three"), (None, "x\ty"), (2, None), (3, ""), (4, "wörter " * 20_000), (5, "a" * 100_000)]


def test_round_trip_of_odd_rows(spark):
    path = tokens.vocabulary_path(FILES[0])
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", F.lit(7).alias("ids"), F.lit("x").alias("decoded"))
    t = library(path)
    want = sorted((repr(d), t.encode_ordinary(x or ""), (x or "").encode()) for d, x in ROWS)
    assert sorted((repr(r.doc_id), r.ids, bytes(r.decoded)) for r in byte_bpe.round_trip(docs, path).collect()) == want
    both = byte_bpe.decode(byte_bpe.encode(docs, path), path)
    assert sorted((repr(r.doc_id), bytes(r.decoded)) for r in both.collect()) == [(d, b) for d, _, b in want]
    assert byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), path).where("length(decoded) = 0").count() == 2
    assert byte_bpe.round_trip(docs.limit(0), path).count() == 0


def test_query_equals_the_library(spark):
    t = library(tokens.vocabulary_path(FILES[0]))
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode_bytes(ids)).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.query(spark, sf).collect()}
    assert got == want
