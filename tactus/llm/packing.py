"""Packing along a space-filling curve.

Each document's hashed vector (counts of its ids by cell), projected by a fixed pseudo-random matrix, is a point in four dimensions;
documents are range-sorted by the point's Hilbert key, so that neighbours on the curve have like contents; each range is
packed in that order, cut where a sequence is full. What is left at the end of a range goes into sequences whose lengths are
powers of two, which need no padding.

Defined results: a null text is empty and has its end id only; null and repeated doc_ids, and equal rows, are documents of their own;
points that tie are ordered by doc_id and ids; a text of any length is encoded whole and cut where sequences are full; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_kept, in_batches, stored, table, texts
from .tokens import encoder, ids_crc32, sent, vocabulary_path

END_ID = 0
LENGTH = 1024
DIMENSIONS, BITS = 4, 12
#: Bytes of ids in a range of the curve.
RANGE_BYTES = 64 << 20
#: Cells that a document vector is hashed to.
CELLS = 1024


def projection(cells: int = CELLS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Pseudo-random signs and sizes in [-1, 1) for each cell and dimension, from a multiplicative hash."""
    with np.errstate(over="ignore"):
        z = np.arange(1, cells * dimensions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((z >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1).reshape(cells, dimensions)


def point(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The document's vector, ids counted by the hash id mod CELLS, projected and scaled to its length."""
    return np.bincount(ids % len(matrix), minlength=len(matrix)) @ matrix / len(ids)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row's cell on the Hilbert curve through a grid of 2**bits cells a side."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in range(dims):
            up = (x[axis] >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(up, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (16-bit little-endian, with the end id) and the Hilbert key of each document."""
    end, spec = struct.pack("<H", end_id), sent(docs.sparkSession, tokenizer)

    def start():
        encode, matrix = encoder(spec.value).encode, projection()

        def each(batch: pa.RecordBatch) -> dict:
            ids = [x + end for x in encode(batch.column("text").to_pylist())]
            points = np.array([point(np.frombuffer(x, "<u2"), matrix) for x in ids]).reshape(-1, DIMENSIONS)
            cells = np.clip((0.5 + 0.5 * np.tanh(4 * points)) * (1 << BITS), 0, (1 << BITS) - 1)
            return {"doc_id": batch.column("doc_id"), "hilbert": hilbert_keys(cells), "ids": pa.array(ids, pa.binary())}

        return each

    return in_batches(texts(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id long, hilbert long, ids binary", start)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        from pyspark import TaskContext

        forget_kept()  # the tokenizer's memory of the stage before
        seq, tail = TaskContext.get().partitionId() << 36, []
        used = 0
        for batch in batches:
            out = []
            for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids, at = np.frombuffer(raw, "<u2"), 0
                while at < len(ids):
                    n = min(length - used, len(ids) - at)
                    tail.append((d, at, ids[at : at + n], len(ids)))
                    at, used = at + n, used + n
                    if used == length:
                        out += rows(tail, seq)
                        seq, tail, used = seq + 1, [], 0
            if out:
                yield columns(out)
        out, offset = [], 0
        # The rest: each piece is cut where the power of two that has begun is full.
        room = 1 << (used.bit_length() - 1) if used else 0
        begun: list = []
        for d, at, ids, total in tail:
            while len(ids):
                n = min(room - offset, len(ids))
                begun.append((d, at, ids[:n], total))
                at, ids, offset, used = at + n, ids[n:], offset + n, used - n
                if offset == room:
                    out += rows(begun, seq)
                    seq, begun, offset = seq + 1, [], 0
                    room = 1 << (used.bit_length() - 1) if used else 0
        if out:
            yield columns(out)

    def rows(pieces: list, seq: int) -> list[tuple]:
        made, offset = [], 0
        for d, at, ids, total in pieces:
            made.append((d, at, len(ids), ids_crc32(ids), total, seq, offset, ids.tobytes()))
            offset += len(ids)
        return made

    def columns(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for c, x in zip(cols, zip(*made, strict=True), strict=True)], cols)

    # Stored, so that sampling the ranges doesn't run the tokenizer a second time.
    points = stored(tokenized(docs, tokenizer, end_id), "packing-ids")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(points.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // RANGE_BYTES))
    curve = points.repartitionByRange(parts, "hilbert", "doc_id").sortWithinPartitions("hilbert", "doc_id", "ids")
    return curve.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json")).drop("ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, with their ids; each row is a document of its own, with a null or repeated doc_id as well.

    Rows that tie on the curve are ordered by doc_id and ids, so equal rows are interchangeable; null texts have their end id only; an
    empty table gives an empty result; columns of docs other than doc_id and text, whatever their names, are left out.
    """
    return pack(docs, vocabulary_path("byte_bpe_50k.json"))
