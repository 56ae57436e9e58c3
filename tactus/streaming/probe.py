"""A listener that turns a query's progress into rows of the probe schema, one a batch."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tactus.sources.readers import PROBE


class ProbeListener(StreamingQueryListener):
    """Rows (iter, compute_ns, wake_lag_ns, e2e_ns) of the queries with a name: the batch, the time of its work, how long it
    started after it was due (by ``interval_ms``, that of the query's trigger; 0 without one), and both with all overhead.

    Rows are written as CSV files to ``path`` whenever ``flush`` of them are held and when the query ends.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, interval_ms: int | None = None, flush: int = 1_000):
        self.spark, self.name, self.path, self.interval, self.flush = spark, name, path, interval_ms, flush
        self.rows: list[tuple[int, int, int, int]] = []
        self.query, self.ended, self.lock = None, threading.Event(), threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.query = event.id

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name != self.name:
            return
        took = p.durationMs
        whole, work = took.get("triggerExecution", 0), took.get("addBatch", 0)
        lag = _millis(p.timestamp) % self.interval if self.interval else 0
        with self.lock:
            self.rows.append((p.batchId, work * 1_000_000, lag * 1_000_000, (lag + whole) * 1_000_000))
            if len(self.rows) >= self.flush:
                self._write()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.id == self.query:
            with self.lock:
                self._write()
            self.ended.set()

    def _write(self) -> None:
        if self.rows:
            frame: DataFrame = self.spark.createDataFrame(self.rows, PROBE)
            frame.coalesce(1).write.mode("append").csv(self.path, header=True)
            self.rows = []


def _millis(stamp: str) -> int:
    from datetime import datetime

    return round(datetime.fromisoformat(stamp).timestamp() * 1000)
