"""Windows and chains of windows over live streams: one stateful operator, keyed by ranges of the index.

A range holds the records that outputs still need, one entry a record, and the ``halo`` records before its first one. An
output leaves once, in the batch that brings the last record of its window, in whatever order records come; a record is
dropped when its last output has left. When the watermark passes a range's last slot, no record can come any more, and a timer
drops what gaps have left there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tactus.functions.kernels import Compute

#: Records in a range of the index: few enough that a batch has many ranges, many beside a halo.
RANGE = 10_000


class Halo(StatefulProcessor):
    """Outputs of one range of the index. ``step``: only those at its multiples; ``ends``: (range) -> milliseconds of its last slot."""

    def __init__(self, outputs: int, halo: int, compute: Compute, span: int, step: int, ends: Callable[[int], int]):
        self.outputs, self.halo, self.compute, self.span, self.step, self.ends = outputs, halo, compute, span, step, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "p binary, x binary, valid binary, uses binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = int(key[0])
        first, last = at * self.span, (at + 1) * self.span - 1
        new = pd.concat(rows, ignore_index=True).drop_duplicates("p")
        p = new["p"].to_numpy(np.int64)
        x, valid = new["v"].to_numpy(np.int64), new["there"].to_numpy(bool)
        # Outputs of this range that a record counts in; the stream has none before a whole halo.
        uses = np.minimum(p + self.halo, last) - np.maximum(p, max(first, self.halo)) + 1
        fresh = np.ones(len(p), bool)
        if self.held.exists():
            old_p, old_x, old_valid, old_uses = self._unpacked(self.held.get())
            again = np.isin(p, old_p)
            p, x, valid, uses = (np.concatenate([a, b[~again]]) for a, b in ((old_p, p), (old_x, x), (old_valid, valid), (old_uses, uses)))
            fresh = np.concatenate([np.zeros(len(old_p), bool), fresh[~again]])
        else:
            self.handle.registerTimer(self.ends(at))
        order = np.argsort(p, kind="stable")
        p, x, valid, uses, fresh = (a[order] for a in (p, x, valid, uses, fresh))
        out, h = [], self.halo
        cuts = np.flatnonzero(np.diff(p) != 1) + 1
        for a, b in zip([0, *cuts], [*cuts, len(p)], strict=True):
            if b - a <= h:
                continue
            # Full windows of this run end at a + h .. b - 1; those with a new record haven't left yet.
            seen = np.concatenate([[0], np.cumsum(fresh[a:b])])
            end = np.flatnonzero((seen[h + 1 :] > seen[: -h - 1]) & (p[a + h : b] >= first)) + h
            if not len(end):
                continue
            y, ok = self.compute(x[a:b], valid[a:b])
            done = np.zeros(b - a + 1, np.int64)
            np.add.at(done, end - h, 1)
            np.add.at(done, end + 1, -1)
            uses[a:b] -= np.cumsum(done)[:-1]
            shown = end[p[a + end] % self.step == 0]
            out.append((p[a + shown] // self.step, y[shown], ok[shown]))
        keep = uses > 0
        if keep.any():
            self.held.update((p[keep].tobytes(), x[keep].tobytes(), valid[keep].tobytes(), uses[keep].tobytes()))
        elif self.held.exists():
            self.held.clear()
        for n, y, ok in out:
            yield pd.DataFrame({"n": n} | {f"f{i}": pd.arrays.IntegerArray(y[:, i].copy(), ~ok[:, i]) for i in range(self.outputs)})

    def _unpacked(self, held: tuple) -> tuple[np.ndarray, ...]:
        p, x, valid, uses = held
        return np.frombuffer(p, np.int64), np.frombuffer(x, np.int64), np.frombuffer(valid, bool), np.frombuffer(uses, np.int64).copy()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists():
            self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def over_halo(df: DataFrame, outputs: int, halo: int, compute: Compute, ends: Callable[[int], int], step: int = 1, span: int = RANGE) -> DataFrame:
    """(n, f0, ...): ``compute`` over each position and the ``halo`` before it; df has the position p, the value v, and slot with a watermark."""
    if halo >= span:
        raise ValueError("a window must be shorter than a range of the index")
    # A record goes to its own range, and to the next one if that one's first outputs need it.
    at = F.explode(F.expr(f"sequence(p div {span}L, (p + {halo}L) div {span}L)"))
    x = df.select("p", "slot", F.coalesce(F.col("v").cast("long"), F.lit(0)).alias("v"), F.col("v").isNotNull().alias("there"), at.alias("range"))
    schema = StructType([StructField(c, LongType()) for c in ("n", *(f"f{i}" for i in range(outputs)))])
    return x.groupBy("range").transformWithStateInPandas(Halo(outputs, halo, compute, span, step, ends), schema, "append", "eventTime")
