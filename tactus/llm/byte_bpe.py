"""Byte-level BPE by a sentencepiece model that is written directly from a vocabulary of ranks.

The model's pieces are the vocabulary's byte strings, each byte as one printable character, scored by their negative rank, so that
the best merge is that of the lowest rank; the normalizer is the identity. A text is cut into pre-tokens by the pattern;
each is encoded by the model by itself, unless the vocabulary holds it whole, and decoding maps the pieces' characters back to bytes.
What recurs is remembered within bounds, as ``tokens`` says.

Defined results: a null text is empty and has no ids; null and repeated doc_ids, and equal rows, are documents of their own; texts of any
length are encoded whole; strings of special tokens are ordinary text; an empty table gives an empty result; other columns are
ignored, whatever their names. Vocabularies have every single byte and at most 65,536 ids.
"""

from __future__ import annotations

import base64
import struct
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, kept_by_worker, table, texts
from .tokens import BYTE_PIECES, ByteEncoder, byte_characters, sent, vocabulary_path

#: Fields of sentencepiece's model format: fixed values, given by its public definition.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE = 3, 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def ranks(spec: str) -> list[bytes | None]:
    """Bytes of each id of a vocabulary file: lines of a base64 string and its rank."""
    pairs = [(base64.b64decode(a), int(b)) for a, b in map(str.split, filter(None, spec.splitlines()))]
    out: list[bytes | None] = [None] * (max(r for _, r in pairs) + 1)
    for piece, rank in pairs:
        out[rank] = piece
    return out


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n)


def message(field: int, body: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(body)) + body


def as_characters(piece: bytes) -> str:
    return piece.decode("latin-1").translate(byte_characters())


def model(pieces: list[bytes | None]) -> bytes:
    """A serialized BPE model whose piece i is ``pieces[i]``; ids that the vocabulary leaves out, and the unknown piece at the end, match nothing."""
    out = []
    for rank, piece in enumerate(pieces):
        body = message(PIECE, (f"{rank}" if piece is None else as_characters(piece)).encode())
        out.append(message(PIECES, body + varint(SCORE << 3 | 5) + struct.pack("<f", -rank) + number(KIND, NORMAL)))
    out.append(message(PIECES, message(PIECE, b"<unk>") + number(KIND, UNKNOWN)))
    plain = b"".join(number(f, 0) for f in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES))
    return b"".join(out) + message(TRAINER, number(MODEL_TYPE, BPE)) + message(NORMALIZER, message(NAME, b"identity") + plain)


class RankEncoder(ByteEncoder):
    """Chunks of bytes -> ids, as ``ByteEncoder``, with the pieces encoded by a sentencepiece model of the vocabulary."""

    def __init__(self, spec: str):
        from sentencepiece import SentencePieceProcessor

        self.bytes_of = ranks(spec)
        if len(self.bytes_of) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.normalizer = None
        self.processor = SentencePieceProcessor(model_proto=model(self.bytes_of))
        self.known = {as_characters(b): i for i, b in enumerate(self.bytes_of) if b is not None}
        self.begin(BYTE_PIECES)

    def of_piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.table)
        whole = self.known.get(mapped)
        ids = self.processor.encode(mapped) if whole is None else [whole]
        return array("H", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.cut(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def rank_encoder(spec: str) -> RankEncoder:
    return kept_by_worker(f"ranks:{len(spec)}:{zlib.crc32(spec.encode())}", lambda: RankEncoder(spec))


def _lists(ids: list[bytes]) -> pa.Array:
    """Documents' 16-bit ids as one list each."""
    ends = np.cumsum([0, *(len(x) // 2 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u2").astype(np.int32)))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text."""
    return _each(docs, vocabulary, "ids array<int>", lambda e: lambda batch: {"ids": _lists(e.encode(batch.column("text").to_pylist()))}, texts)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, decoded binary) of each row's ids; null ids are no bytes. An id that the vocabulary lacks is an error."""
    ids = lambda df: df.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return _each(encoded, vocabulary, "decoded binary", lambda e: lambda batch: {"decoded": pa.array(map(e.decode, batch.column("ids").to_pylist()), pa.binary())}, ids)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded): both in one pass over the rows, so that a task needs one worker; ``decoded`` is made of the ids alone."""

    def of(e: RankEncoder) -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            ids = _lists(e.encode(batch.column("text").to_pylist()))
            return {"ids": ids, "decoded": pa.array([e.decode(x) for x in map(np.ndarray.tolist, np.split(ids.values.to_numpy(), ids.offsets.to_numpy()[1:-1]))], pa.binary())}

        return each

    return _each(docs, vocabulary, "ids array<int>, decoded binary", of, texts)


def _each(df: DataFrame, vocabulary: str, columns: str, of: Callable, inputs: Callable) -> DataFrame:
    spec = sent(df.sparkSession, vocabulary)

    def start() -> Callable:
        each = of(rank_encoder(spec.value))
        return lambda batch: {"doc_id": batch.column("doc_id"), **each(batch)}

    return in_batches(inputs(df.withColumn("doc_id", F.col("doc_id").cast("long"))), f"doc_id long, {columns}", start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
