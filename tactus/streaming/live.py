"""Stream operators on Structured Streaming.

Stateless operators are the batch code over a live ``Stream``; here are sources, sinks, and the operators that hold state. Event time is
a record's slot; how long a watermark waits follows from when a node's records arrive, which each node knows of its inputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tactus.functions import kernels
from tactus.operators import pipelines
from tactus.operators import streams as S
from tactus.sources.readers import shared_folder

from . import stateful

#: Slot 0 of the clock in microseconds: well after the epoch, so that a first watermark doesn't drop the first records.
BASE = 86_400_000_000
#: End of a stream that has none.
UNBOUNDED = 1 << 50
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- sources ---
def rate_source(spark: SparkSession, per_second: int) -> DataFrame:
    """An unbounded stream of records with a hash for payload."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("n"), F.pmod(F.xxhash64("value"), F.lit(256)).alias("f0"))


def live_table(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A folder or file of Parquet as a stream of records."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    read = spark.readStream.schema(schema)
    source = read.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else read.parquet(path)
    return source.select(F.col(key).cast("long").alias("n"), F.expr(value).alias("f0"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def record(s: S.Stream, path: str, seconds: Fraction | str, batches: int) -> None:
    """A stream's records as ``batches`` files, in the order of their time: each covers so many seconds, the last one all that is left.

    Each file is written by a job of its own, as a file source reads them by age.
    """
    for i in range(batches):
        first, last = (floor(j * Fraction(seconds) / s.delta) for j in (i, i + 1))  # record n comes at (n + 1) * delta
        here = F.col("n") >= first if i == batches - 1 else F.col("n").between(first, last - 1)
        s.trimmed().where(here).coalesce(1).write.mode("append").parquet(path)


def replayed(spark: SparkSession, path: str, like: S.Stream, end: int | None = None) -> S.Stream:
    """What ``record`` has written as a live stream, a file a batch; ``end`` where it is known."""
    schema = StructType([like.df.schema[c] for c in ("n", *like.fields)])
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return S.Stream(df, like.delta, like.width, like.origin, UNBOUNDED if end is None else end)


# --- event time ---
def slot_micros(n: int, delta: Fraction) -> int:
    return BASE + n * delta.numerator * 1_000_000 // delta.denominator


def slot_time(n: str, delta: Fraction) -> Column:
    """Instant of slot n, floored to microseconds."""
    return F.timestamp_micros(F.lit(BASE) + F.expr(f"({n} * {delta.numerator * 1_000_000}L) div {delta.denominator}L"))


def disorder(s: S.Stream) -> Fraction:
    """Greatest time by which the slot of a record exceeds that of one that arrives later; two periods and what they overlap show it."""
    late = [s.comes(n) - n * s.delta for n in range(s.origin, s.origin + s.period)]
    count = 2 * s.period + ceil((max(late) - min(late)) / s.delta) + 1
    worst, top, held = Fraction(0), None, None
    for at, slot in sorted((s.comes(n), n * s.delta) for n in range(s.origin, s.origin + count)):
        if held is not None and at > held[0]:
            top, held = held[1] if top is None else max(top, held[1]), None
        worst = worst if top is None else max(worst, top - slot)
        held = (at, slot) if held is None else (at, max(held[1], slot))
    return worst


def least_delay(s: S.Stream) -> int:
    """Milliseconds, which watermarks count in, that one must wait so that no record is late, at most one too many: slots are floored to microseconds, and one at the watermark is late."""
    return floor(disorder(s) * 1000 + Fraction(1, 1000)) + 1


def watermarked(s: S.Stream, delay: int | None = None) -> DataFrame:
    """s with its slots and a watermark on them; ``delay`` in milliseconds is the least one if it isn't given."""
    return s.df.withColumn("slot", slot_time("n", s.delta)).withWatermark("slot", f"{least_delay(s) if delay is None else delay} milliseconds")


# --- operators with state ---
def _chained(s: S.Stream, out: S.Stream, outputs: int, halo: int, compute: kernels.Compute, step: int, delay: int | None, span: int) -> S.Stream:
    """``compute`` over the flattened positions of s, n * width + i."""
    x = watermarked(s, delay)
    if s.width > 1:
        x = x.select("n", "slot", F.posexplode(F.array(*[F.col(f).cast("long") for f in s.fields]))).select((F.col("n") * s.width + F.col("pos")).alias("p"), "slot", F.col("col").alias("v"))
    else:
        x = x.select(F.col("n").alias("p"), "slot", F.col("f0").alias("v"))
    width, delta = s.width, s.delta
    ends = lambda at: -(-slot_micros(((at + 1) * span - 1) // width, delta) // 1000)
    df = stateful.over_halo(x, outputs, halo, compute, ends, step, span)
    return replace(out, df=df.where((F.col("n") >= out.origin) & (F.col("n") < out.end)), width=outputs)


def window_reduce(s: S.Stream, step: int, length: int, *reducers: str, delay: int | None = None, span: int = stateful.RANGE) -> S.Stream:
    """A live window with reducers over it: the records, fields and NULLs of the batch form, an entry of state a record."""
    size = abs(length)
    return _chained(s, S._windowed(s, step, size), len(reducers), size - 1, kernels.reducers(size, reducers), step, delay, span)


def fir(s: S.Stream, taps: list[int], scale: tuple[int, ...] = (), delay: int | None = None, span: int = stateful.RANGE) -> S.Stream:
    """A live filter, divided by each of ``scale`` in turn."""
    return _chained(s, S._windowed(s, 1, len(taps)), 1, len(taps) - 1, kernels.filtered(taps, scale), 1, delay, span)


def qrs_features(s: S.Stream, taps: list[int], delay: int | None = None, span: int = stateful.RANGE) -> DataFrame:
    """The live ECG chain over f0: band pass, derivative, square and both averages in one operator with one halo."""
    halo = len(taps) + len(pipelines.DERIVATIVE) + pipelines.SHORT + pipelines.LONG - 4
    one = s.select(F.col("f0"))
    q = _chained(one, S._windowed(one, 1, halo + 1), 3, halo, kernels.qrs(taps, pipelines.DERIVATIVE, pipelines.SHORT, pipelines.LONG), 1, delay, span).df.where("f2 is not null")
    return q.select("n", (F.col("f0") - 900).alias("out_0"), (F.col("f1") * 5).alias("out_1"), ((F.col("f1") - F.col("f2") * 2) * 5).alias("out_2"))


def add(a: S.Stream, b: S.Stream) -> S.Stream:
    """Rate-aligned sum of two live streams: the faster side's record n meets floor(n * fast / slow) of the other.

    Both sides' event time is the slower side's slot, a key of the join, so a watermark drops what can't be met any more.
    """
    out, slow = S.add(a, b), max(a.delta, b.delta)

    def side(s: S.Stream, names: list[str]) -> DataFrame:
        u, v = S.ratio(s.delta, slow)
        at = F.expr(f"(n * {u}L) div {v}L")
        # Slots of the slower side are floors of those of the faster one, so their disorder may be a slot greater.
        lag = disorder(s)
        wait = floor((lag + slow if lag and s.delta < slow else lag) * 1000 + Fraction(1, 1000)) + 1
        x = s.df.select("n", at.alias("at"), *[F.col(f).alias(g) for f, g in zip(s.fields, names, strict=True)])
        return x.withColumn("slot", slot_time("at", slow)).withWatermark("slot", f"{wait} milliseconds")

    x = side(a, [f"f{i}" for i in range(a.width)])
    y = side(b, [f"f{a.width + i}" for i in range(b.width)]).withColumnsRenamed({"n": "m", "at": "at2", "slot": "slot2"})
    j = x.join(y, F.expr("at = at2 and slot = slot2" + (" and n = m" if a.delta == b.delta else "")))
    df = j.select((F.col("n") if a.delta <= b.delta else F.col("m")).alias("n"), *out.fields)
    return replace(out, df=df.where((F.col("n") >= out.origin) & (F.col("n") < out.end)))


# --- sinks ---
@contextmanager
def state_store(df: DataFrame) -> Iterator[None]:
    """A query of df that starts inside keeps its state in RocksDB if it has an operator that needs it; the session's setting comes back."""
    spark = df.sparkSession
    had = spark.conf.get(PROVIDER, None)
    if "TransformWithState" in df._jdf.queryExecution().analyzed().toString():
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, had) if had else spark.conf.unset(PROVIDER)


def collected(df: DataFrame) -> DataFrame:
    """Runs the stream over what is there now and returns what it wrote to the shared folder, a folder per batch, which a repeated batch overwrites."""
    spark, name = df.sparkSession, f"sink_{uuid.uuid4().hex}"
    out = f"{shared_folder(spark)}/{name}"
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/none")
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/{i}")
    with state_store(df):
        q = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/*")
