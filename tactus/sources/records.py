"""Files of fixed-width records, and of lines, read by ranges of bytes and numbered in file order.

Both are data sources of Spark: a partition is a range of a file, read as Arrow batches. A record's number follows from where its range
starts; lines are counted per range first, and a range's first number is the running sum of those before it. Files come in the
order of their paths. Paths are those of pyarrow's file systems: folders that all machines share, or stores by URI.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Bytes of a partition, and of one Arrow batch.
SPLIT, CHUNK = 64 << 20, 4 << 20


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) under a path, in the order of their paths; those whose name begins with . or _ aren't data."""
    from pyarrow import fs

    store, at = _opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._")


@dataclass
class Piece(InputPartition):
    """Bytes start .. stop - 1 of a file; ``first``: the number of its first record, or the number of the piece."""

    file: str
    start: int
    stop: int
    first: int


def kinds(layout: str) -> list[str]:
    """Numpy's types of a layout of ``struct`` such as '<ii'."""
    order = layout[0] if layout[0] in "<>" else "="
    return [f"{order}f{struct.calcsize(c)}" if c in "fd" else f"{order}{'u' if c.isupper() else 'i'}{struct.calcsize(order + c)}" for c in layout.lstrip("<>=")]


class FixedRecords(DataSource):
    """Options: path, layout, fields (comma-separated), split (bytes). Columns: n and the fields."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def record(self) -> np.dtype:
        return np.dtype({"names": self.options["fields"].split(","), "formats": kinds(self.options["layout"])})

    def schema(self) -> StructType:
        r = self.record()
        return StructType([StructField("n", LongType()), *[StructField(f, DoubleType() if r[f].kind == "f" else LongType()) for f in r.names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FixedReader(self.options["path"], self.record(), int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FixedWriter(self.options["path"], self.record(), overwrite)


class FixedReader(DataSourceReader):
    def __init__(self, path: str, record: np.dtype, split: int):
        self.path, self.record, self.split = path, record, max(1, split // record.itemsize) * record.itemsize

    def partitions(self) -> list[Piece]:
        out, first, size = [], 0, self.record.itemsize
        for file, length in _files(self.path):
            if length % size:
                raise ValueError(f"{file} has {length} bytes, no multiple of {size}")
            out += [Piece(file, a, min(length, a + self.split), first + a // size) for a in range(0, length, self.split)]
            first += length // size
        return out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # there is no file
            return
        store, _ = _opened(self.path)
        step = max(1, CHUNK // self.record.itemsize) * self.record.itemsize
        n = piece.first
        with store.open_input_file(piece.file) as f:
            for at in range(piece.start, piece.stop, step):
                x = np.frombuffer(f.read_at(min(step, piece.stop - at), at), self.record)
                cols = [x[c].astype(np.float64 if x[c].dtype.kind == "f" else np.int64) for c in self.record.names]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(n, n + len(x)), *cols)], ["n", *self.record.names])
                n += len(x)


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    records: int


class FixedWriter(DataSourceArrowWriter):
    """A task writes a hidden file; the commit gives the files their names in the order of partitions, so failed tasks leave nothing that is read."""

    def __init__(self, path: str, record: np.dtype, overwrite: bool):
        self.path, self.record, self.overwrite = path, record, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        part, count = TaskContext.get().partitionId(), 0
        file = f"{at}/.{part:08d}-{uuid.uuid4().hex}"
        with store.open_output_stream(file) as f:
            for batch in iterator:
                x = np.zeros(batch.num_rows, self.record)
                for c in self.record.names:
                    column = batch.column(c)
                    if column.null_count:
                        raise ValueError(f"{c} has missing values; records of fixed width have none")
                    v = column.to_numpy(zero_copy_only=False)
                    x[c] = v
                    if x[c].dtype.kind != "f" and not np.array_equal(x[c].astype(v.dtype), v):
                        raise ValueError(f"a value of {c} doesn't fit its field")
                f.write(x.tobytes())
                count += batch.num_rows
        return Written(part, file, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _opened(self.path)
        old = [f for f, _ in _files(self.path)] if store.get_file_info(at).type.name != "NotFound" else []
        if self.overwrite:
            for f in old:
                store.delete_file(f)
        first = 0 if self.overwrite or not old else int(old[-1].rsplit("-", 1)[1].split(".")[0]) + 1
        for m in filter(None, messages):
            store.move(m.file, f"{at}/part-{first + m.part:08d}.bin") if m.records else store.delete_file(m.file)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.path)
        for m in filter(None, messages):
            store.delete_file(m.file)


class Lines(DataSource):
    """Options: path, split (bytes). Columns: piece, at (the line's place among the piece's lines that aren't blank), value."""

    @classmethod
    def name(cls) -> str:
        return "file_lines"

    def schema(self) -> StructType:
        return StructType([StructField("piece", LongType()), StructField("at", LongType()), StructField("value", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(self.options["path"], int(self.options.get("split", SPLIT)))


class LineReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Piece]:
        pieces = [(file, a, min(length, a + self.split)) for file, length in _files(self.path) for a in range(0, length, self.split)]
        return [Piece(*p, i) for i, p in enumerate(pieces)]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the piece, of which the last may end behind it; a piece is held in memory."""
        if piece is None:  # there is no file
            return
        store, _ = _opened(self.path)
        with store.open_input_file(piece.file) as f:
            start = max(0, piece.start - 1)
            held = [f.read_at(piece.stop - start, start)]
            if piece.start > 0:
                held = [held[0].partition(b"\n")[2]]
            at, ended = piece.stop, not held[0] or held[0].endswith(b"\n")
            while not ended and (more := f.read_at(1 << 16, at)):
                head, mark, _ = more.partition(b"\n")
                held.append(head)
                at, ended = at + len(more), bool(mark)
        lines = [x for x in b"".join(held).split(b"\n") if x.strip()]
        for i in range(0, len(lines), 100_000):
            yield self._batch(piece, i, lines[i : i + 100_000])

    @staticmethod
    def _batch(piece: Piece, place: int, lines: list[bytes]) -> pa.RecordBatch:
        cols = [np.full(len(lines), piece.first), np.arange(place, place + len(lines)), [x.decode("utf-8", "replace") for x in lines]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["piece", "at", "value"])


def binary_records(spark: SparkSession, path: str, layout: str, fields: list[str], split: int = SPLIT) -> DataFrame:
    """(n, fields) of fixed-length binary records, numbered in file order; layout is that of ``struct``, such as '<ii'."""
    spark.dataSource.register(FixedRecords)
    return spark.read.format("fixed_records").options(path=path, layout=layout, fields=",".join(fields), split=str(split)).load()


def write_records(df: DataFrame, path: str, layout: str, fields: list[str], mode: str = "overwrite") -> None:
    """The fields in the order of n, as records of fixed width in files by ranges of n. A missing value, or one that doesn't fit, is an error."""
    df.sparkSession.dataSource.register(FixedRecords)
    ordered = df.repartitionByRange("n").sortWithinPartitions("n").select(*[F.col(f).cast("double" if k[1] == "f" else "long").alias(f) for f, k in zip(fields, kinds(layout), strict=True)])
    ordered.write.format("fixed_records").options(path=path, layout=layout, fields=",".join(fields)).mode(mode).save()


def numbered_lines(spark: SparkSession, path: str, fields: list[str], split: int = SPLIT) -> DataFrame:
    """(n, fields) of lines without an index: white-space separated values, numbered in file order; the word NULL is no value, blank lines don't count."""
    spark.dataSource.register(Lines)
    rows = spark.read.format("file_lines").options(path=path, split=str(split)).load()
    # A row per piece: its first number is the count of lines before it.
    before = F.coalesce(F.sum("k").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("piece").agg(F.count("*").alias("k")).select("piece", before.alias("first"))
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    cols = [F.when(F.upper(F.get(parts, i)) != "NULL", F.get(parts, i).cast("long")).alias(f) for i, f in enumerate(fields)]
    return rows.join(starts, "piece").select((F.col("first") + F.col("at")).alias("n"), *cols)
