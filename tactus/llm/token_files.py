"""Token-id files: a concatenated id array and Elias-Fano encoded document boundaries.

A shard file holds, little-endian: 8 bytes magic; the length of a JSON header and the header; the ids (16 bits each); then
two Elias-Fano sequences, the documents' ends and their doc_ids. A sequence of n non-decreasing values below u takes about
2 + log2(u / n) bits a value: the low bits packed, the high bits in unary, and for select a 32-bit position for every
256th one. Any boundary is read without decoding those before it. Shards ascend by doc_id; the manifest has a row per
shard with the number of ids before it.

Defined results: a null text is empty and has its end id only; null doc_ids come first; repeated doc_ids are documents of
their own, in the order of their texts, equal rows side by side; a text of any length is encoded whole and lies in one shard; an empty
table writes no shard; other columns are ignored. A shard is written under
a name of its own and then moved, so a task that runs again after a lost executor replaces it by the same bytes.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, scratch, short_batches, table, text_bytes, texts
from .tokens import encoder, ids_crc32, sent, vocabulary_path

MAGIC = b"EFTOKEN1"
END_ID = 1
#: Ids in a shard, at least until the document that passes it ends.
SHARD_IDS = 8_000_000
#: Bytes of text in a range of doc_ids.
PART_BYTES = 64 << 20
STEP = 256


class EliasFano:
    """Non-decreasing integers 0 <= v; ``select`` gets any of them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sampled: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sampled = n, low_bits, low, high, sampled

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::STEP].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i: the position of the i-th one in the high bits, found from the last sampled one, and the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.sampled[i // STEP]), i % STEP
        byte = at // 8
        window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        window[: at % 8] = 0
        found = np.flatnonzero(window)
        width = 64
        while len(found) <= left:
            width *= 4
            window = np.unpackbits(self.high[byte : byte + width], bitorder="little")
            window[: at % 8] = 0
            found = np.flatnonzero(window)
        high = byte * 8 + int(found[left]) - i
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        bits = int.from_bytes(self.low[a // 8 : (b + 7) // 8].tobytes(), "little") >> (a % 8)
        return (high << self.low_bits) | (bits & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        """Every value, in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.int64)
        high = ones - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (bits << np.arange(self.low_bits, dtype=np.int64)).sum(axis=1)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.sampled.view(np.uint8)]

    def head(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "sizes": [len(x) for x in self.parts()]}

    @classmethod
    def parse(cls, head: dict, data: np.ndarray) -> EliasFano:
        low, high, sampled = np.split(data, np.cumsum(head["sizes"])[:2])
        return cls(head["n"], head["low_bits"], low, high, sampled.view("<u4"))


class Shard:
    """A shard file in memory: ids of any document by the select structures."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<I", data[8:12])[0]
        h = json.loads(data[12 : 12 + size])
        raw = np.frombuffer(data, np.uint8, offset=12 + size)
        sizes = [2 * h["n_ids"], sum(h["ends"]["sizes"]), sum(h["docs"]["sizes"])]
        ids, ends, docs = np.split(raw, np.cumsum(sizes)[:2])
        self.ids, self.null_docs, self.least_doc = ids.view("<u2"), h["null_docs"], h["least_doc"]
        self.ends, self.docs = EliasFano.parse(h["ends"], ends), EliasFano.parse(h["docs"], docs)

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.null_docs else self.docs.select(i - self.null_docs) + self.least_doc


def shard_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = EliasFano.build(np.cumsum([len(x) // 2 for x in ids]))
    docs = EliasFano.build(known - least)
    h = {"n_ids": sum(map(len, ids)) // 2, "null_docs": len(doc_ids) - len(known), "least_doc": least, "ends": ends.head(), "docs": docs.head()}
    head = json.dumps(h).encode()
    head += b" " * (-(12 + len(head)) % 8)
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *ids, *(x.tobytes() for x in ends.parts() + docs.parts())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes shards and ``path/manifest``; returns the manifest: shard, n_docs, n_ids, base (ids before the shard)."""
    spark = docs.sparkSession
    end, spec = struct.pack("<H", end_id), sent(spark, tokenizer)

    def start():
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), {"seq": 0}
        fs, root = pyarrow.fs.FileSystem.from_uri(f"{path}/shards")
        encode = encoder(spec.value).encode

        def flush(doc_ids: list, ids: list[bytes]) -> dict:
            name = f"{part:06d}-{state['seq']:06d}"
            state["seq"] += 1
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(own := f"{root}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(shard_bytes(doc_ids, ids))
            fs.move(own, f"{root}/{name}")
            return {"shard": [name], "n_docs": [len(ids)], "n_ids": [sum(map(len, ids)) // 2]}

        return encode, flush

    def run(batches):
        encode, flush = start()
        doc_ids, ids, held = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(d)
                ids.append(t + end)
                held += len(t) // 2 + 1
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pydict(flush(doc_ids, ids))
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pydict(flush(doc_ids, ids))

    short_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // PART_BYTES))
    ordered = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "shard string, n_docs long, n_ids long").write.parquet(f"{path}/written")
    w = spark.read.parquet(f"{path}/written")
    # A row per shard, some tens of MB of ids each.
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    w.withColumn("base", base).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def start():
        fs, root = pyarrow.fs.FileSystem.from_uri(f"{path}/shards")

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
            for name, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    s = Shard(f.read())
                begin = 0
                for i in range(len(s)):
                    end = s.ends.select(i)
                    out["doc_id"].append(s.doc_id(i))
                    out["start"].append(base + begin)
                    out["n_tokens"].append(end - begin)
                    out["ids_crc32"].append(ids_crc32(s.ids[begin:end]))
                    begin = end
            return {k: pa.array(v, pa.int64()) for k, v in out.items()}

        return each

    manifest = spark.read.parquet(f"{path}/manifest")
    n = max(1, manifest.count())
    return in_batches(manifest.select("shard", "base").repartition(n), "doc_id long, start long, n_tokens long, ids_crc32 long", start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"))
    return read_token_files(spark, path)
