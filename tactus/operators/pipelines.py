"""Ready pipelines over streams. A chain of windows shuffles once: its stages run in buckets that hold the sum of their halos."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tactus.functions import kernels
from tactus.functions.expr import idiv

from .streams import BUCKET, Stream, add, fir, in_buckets, interleave, shift, weighted, window_reduce

#: Records that go through a kernel at once.
RUN = 200_000
DERIVATIVE = [-1, -2, 0, 2, 1]
SHORT, LONG = 30, 180


def union(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def scaled_fir(s: Stream, taps: list[int]) -> Stream:
    f = fir(s, taps)
    return f.select(idiv(idiv(F.col("f0"), len(taps)), 1000))


def fir_with_source(s: Stream, taps: list[int]) -> Stream:
    return add(scaled_fir(s, taps), s)


def over_halo(s: Stream, halo: int, compute: kernels.Compute, names: list[str], bucket: int = RUN) -> DataFrame:
    """(n, the fields of s, names): a kernel over f0 at each record that has ``halo`` consecutive ones before it.

    One shuffle by ranges of the index, of which each goes through the kernel as arrays; a record is copied to two ranges at most.
    """
    b = in_buckets(s.df.withColumnRenamed("n", "p"), 1, halo + 1, bucket)
    fields, schema = s.fields, StructType([StructField("n", LongType()), *[s.df.schema[f] for f in s.fields], *[StructField(x, LongType()) for x in names]])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("p")
        p, f0 = rows["p"].to_numpy(), rows["f0"].combine_chunks()
        valid = f0.is_valid().to_numpy(zero_copy_only=False)
        y, ok = kernels.in_runs(p, f0.fill_null(0).cast(pa.int64()).to_numpy(), valid, halo, compute, len(names))
        at = np.flatnonzero((kernels.before(p) >= halo) & (p // bucket == rows["bucket"][0].as_py()))
        out = rows.select(["p", *fields]).take(pa.array(at))
        cols = [*out.columns, *(pa.array(y[at, i], mask=~ok[at, i]) for i in range(len(names)))]
        return pa.Table.from_arrays(cols, schema.names)

    return b.groupBy("bucket").applyInArrow(run, schema)


def qrs_chain(s: Stream, taps: list[int], bucket: int = RUN) -> DataFrame:
    """(n, f0.., mwi, thr): band pass, derivative, square, short and long averages, all in one shuffle. A record with a NULL in its halo is left out."""
    halo = len(taps) + len(DERIVATIVE) + SHORT + LONG - 4
    return over_halo(s, halo, kernels.qrs(taps, DERIVATIVE, SHORT, LONG), ["value", "mwi", "thr"], bucket).where("thr is not null").drop("value")


def qrs_features(s: Stream, taps: list[int]) -> DataFrame:
    q = qrs_chain(s, taps)
    return q.select("n", (F.col("f0") - 900).alias("out_0"), (F.col("mwi") * 5).alias("out_1"), ((F.col("mwi") - F.col("thr") * 2) * 5).alias("out_2"))


def qrs_detect(s: Stream, taps: list[int]) -> DataFrame:
    q = qrs_chain(s, taps)
    return q.select("n", (F.col("f0") - 900).alias("out_0"), (F.col("f1") - 900).alias("out_1"), ((F.col("mwi") - F.col("thr") * 2) * 5).alias("out_2"))


def qrs_float(s: Stream, taps: list[float], bucket: int = BUCKET) -> DataFrame:
    """In doubles: a start filled with zeros, true division, taps in reversed order."""
    halo = len(taps) + len(DERIVATIVE) + SHORT + LONG - 4
    w = Window.partitionBy("bucket").orderBy("p")
    zero = lambda name, cs: sum((F.coalesce(F.lag(name, k).over(w), F.lit(0.0)) * F.lit(float(c)) for k, c in enumerate(reversed(cs))), F.lit(0.0))
    over = lambda size: w.rowsBetween(-(size - 1), 0)
    b = in_buckets(s.df.select(F.col("n").alias("p"), F.col("f0").cast("double").alias("x")), 1, halo + 1, bucket)
    b = b.withColumn("bp", zero("x", taps) / 1000).withColumn("d", zero("bp", DERIVATIVE)).withColumn("sq", F.col("d") * F.col("d") / 1000)
    b = b.withColumn("mwi", F.sum("sq").over(over(SHORT)) / SHORT).withColumn("thr", F.sum("mwi").over(over(LONG)) / LONG)
    return b.where(f"p div {bucket} = bucket").select(F.col("p").alias("n"), "mwi", "thr")


def multirate(a: Stream, b: Stream, shift_a: int, shift_b: int, length: int) -> Stream:
    return window_reduce(interleave(shift(a, shift_a), shift(b, shift_b)), 1, length, "avg")


def monitors(s: Stream, count: int) -> Stream:
    """Named monitors over one shared stream: the field plus 0, 1, ..."""
    return s.select(*[F.col("f0") + i for i in range(count)])
