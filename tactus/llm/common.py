"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Rows that one Arrow batch carries to Python. Documents can be long, so batches are short.
BATCH_ROWS = 500
BATCH_BYTES = 32 << 20
#: Bits of the filter that keeps rows that nothing needs out of a shuffle.
FILTER_BITS = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; where that is unset, a local one if all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tactus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage and survives lost executors. ``by``: a column with few values that gives the folders."""
    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most (a longer row is a batch of its own)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict[str, Any] | None]], only: Marked | None = None) -> DataFrame:
    """``mapInArrow`` with short batches. ``start()`` runs once a task and returns what turns a batch into columns; ``only``: for these rows."""
    spark = df.sparkSession
    short_batches(spark)
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            batch = only.of(batch) if only else batch
            out = each(batch) if batch.num_rows else None
            if out is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)

    return (only.numbered(df) if only else df).mapInArrow(run, schema)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the UTF-8 bytes of the whole text (a null text is empty), with further columns as they are."""
    return docs.select("doc_id", *more, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def kept_by_worker(key: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker; workers are reused, so later tasks find it again."""
    import __main__

    held = __main__.__dict__.setdefault("_tactus_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def forget_kept() -> None:
    """Drops what ``kept_by_worker`` holds, for tasks that need the memory and none of it."""
    import __main__

    __main__.__dict__.pop("_tactus_held", None)
    give_back()


def marks(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with those of the ids (column ``id``) set: at most FILTER_BITS / 64 rows come to the driver, whatever the input."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(bit.cast("int").alias("bit")).selectExpr("bit div 64 as at", "shiftleft(1L, bit % 64) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


@dataclass(frozen=True)
class Marked:
    """Rows whose key has its bit in a filter, or those whose key hasn't. A few keys besides those marked have one, all if they are many."""

    key: str
    words: np.ndarray
    others: bool = False

    def numbered(self, df: DataFrame) -> DataFrame:
        return df.select("*", F.pmod(F.xxhash64(self.key), F.lit(FILTER_BITS)))

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The batch's rows of this kind, without the number that ``numbered`` has put last."""
        at = batch.column(batch.num_columns - 1).to_numpy()
        keep = np.flatnonzero(((self.words[at // 64] >> (at % 64)) & 1 == 1) != self.others)
        return batch.select(batch.schema.names[:-1]).take(pa.array(keep))


def filtered(df: DataFrame, only: Marked) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(only.of, batches)

    return only.numbered(df).mapInArrow(run, df.schema)


def compressed(docs: DataFrame, only: Marked) -> DataFrame:
    """The rows of docs with the column z, the compressed text, in place of ``text``."""
    kept = [f for f in docs.schema if f.name != "text"]
    schema = StructType([*kept, StructField("z", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in map(only.of, batches):
            z = pa.array([press(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), z], schema.names)

    short_batches(docs.sparkSession)
    return only.numbered(docs).mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system after a large step, as Python workers go on to tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library where it has it
    if trim:
        trim(0)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from which numbers of parts are derived."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
