"""Subscriptions: a stream's records as a log of batches, and any number of readers, each with a place of its own.

A batch is a folder named by its number and is overwritten if it is run again, so the log holds each record once. A
reader's place is the last record it has taken, (batch, n); each move is a new folder, so a reader goes on where it was after
a crash, and others aren't affected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def publish(df: DataFrame, path: str) -> StreamingQuery:
    """Every batch of a live stream (n, ...) into the log at ``path``, over what is there now."""
    write = df.writeStream.foreachBatch(lambda batch, i: append(batch, path, i))
    return write.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def append(batch: DataFrame, path: str, number: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")


def _finished(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders that were written to their end, ascending."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(f.getPath().getParent().getName().removeprefix(prefix)) for f in (found or []))


@dataclass
class Reader:
    """A named reader of the log at ``path``; schema: that of the records, n first."""

    spark: SparkSession
    path: str
    name: str
    schema: StructType

    def place(self) -> tuple[int, int]:
        """(batch, n) of the last record taken; (-1, -1) before the first."""
        moves = _finished(self.spark, f"{self.path}/readers/{self.name}", "move=")
        if not moves:
            return -1, -1
        r = self.spark.read.schema("batch long, n long").parquet(f"{self.path}/readers/{self.name}/move={moves[-1]}").first()
        return r.batch, r.n

    def _rows(self, after: tuple[int, int]) -> DataFrame | None:
        new = [b for b in _finished(self.spark, f"{self.path}/rows", "batch=") if b >= after[0]]
        if not new:
            return None
        base = f"{self.path}/rows"
        rows = self.spark.read.schema(self.schema).option("basePath", base).parquet(*[f"{base}/batch={b}" for b in new])
        return rows.withColumn("batch", F.col("batch").cast("long")).where((F.col("batch") > after[0]) | (F.col("n") > after[1]))

    def unread(self) -> int:
        rows = self._rows(self.place())
        return rows.count() if rows is not None else 0

    def take(self, limit: int | None = None) -> DataFrame:
        """The next records in the order (batch, n), at most ``limit``; the place moves behind them.

        The order of batches is settled from one count a batch; the batch in which the limit falls is cut at its record's n.
        """
        after = self.place()
        rows = self._rows(after)
        empty = self.spark.createDataFrame([], self.schema)
        if rows is None:
            return empty
        room, last = limit, None
        for r in rows.groupBy("batch").agg(F.count("*").alias("k"), F.max("n").alias("top")).orderBy("batch").toLocalIterator():
            if room is None or r.k <= room:
                last, room = (r.batch, r.top), None if room is None else room - r.k
            elif room > 0:
                cut = rows.where(F.col("batch") == r.batch).select("n").orderBy("n").limit(room).agg(F.max("n")).first()[0]
                last, room = (r.batch, cut), 0
            if room == 0:
                break
        if last is None:
            return empty
        moves = _finished(self.spark, f"{self.path}/readers/{self.name}", "move=")
        at = (moves[-1] if moves else 0) + 1
        self.spark.createDataFrame([last], "batch long, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/readers/{self.name}/move={at}")
        return rows.where((F.col("batch") < last[0]) | ((F.col("batch") == last[0]) & (F.col("n") <= last[1]))).select(*self.schema.names)
