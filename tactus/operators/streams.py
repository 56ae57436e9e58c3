"""The algebra of regular streams on DataFrames.

A stream is a DataFrame with a dense index ``n`` and fields f0, f1, ...; its interval, origin (first index without a hole
after it), end (one past the last) and tail (records that an emission waits for its inputs) are small numbers on the driver. Shift, interleave, both de-interleaves and decimation
are projections and filters; only joins and windows shuffle, and a window shuffles once, by ranges of the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import expr
from tactus.functions.index import cdiv, component_interval, first_reaching, least_tail, left_position, ratio, right_position, window_origin

#: Output records in one bucket of a window.
BUCKET = 100_000


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    delta: Fraction
    width: int
    origin: int = 0
    end: int = 0
    tail: int = 0
    #: When record n is there, in seconds; None for a source, whose record n comes at (n + 1) * delta. The pattern repeats with ``period`` records.
    arrival: Callable[[int], Fraction] | None = field(default=None, compare=False)
    period: int = 1

    def comes(self, n: int) -> Fraction:
        return self.arrival(n) if self.arrival else (n + 1) * self.delta

    @property
    def fields(self) -> list[str]:
        return [f"f{i}" for i in range(self.width)]

    def select(self, *fields: Column) -> Stream:
        """A projection; fields are named f0, f1, ... again."""
        return replace(self, df=self.df.select("n", *[c.alias(f"f{i}") for i, c in enumerate(fields)]), width=len(fields))

    def trimmed(self) -> DataFrame:
        return self.df.where((F.col("n") >= self.origin) & (F.col("n") < self.end))


def from_table(df: DataFrame, key: str, fields: list[Column], delta: Fraction | str) -> Stream:
    """A table with a dense key from 0 on as a stream."""
    delta = Fraction(delta)
    if delta <= 0 or not fields:
        raise ValueError("a stream needs a positive interval and a field")
    end = df.agg(F.max(key)).first()[0]
    return Stream(df.select(F.col(key).cast("long").alias("n"), *[c.alias(f"f{i}") for i, c in enumerate(fields)]), delta, len(fields), 0, 0 if end is None else int(end) + 1)


def cyclic(s: Stream, count: int) -> Stream:
    """Records 0 .. count - 1, where record n is that of n modulo the source's length."""
    copies = cdiv(count, s.end) if s.end else 0
    turn = F.explode(F.sequence(F.lit(0), F.lit(max(copies - 1, 0))))
    df = s.df.select("*", turn.alias("turn")).withColumn("n", F.col("n") + F.col("turn") * s.end).drop("turn").where(F.col("n") < count)
    return replace(s, df=df, end=count if s.end else 0)


def shift(s: Stream, by: int) -> Stream:
    if by < 1:
        raise ValueError("a shift is 1 or more")
    return replace(s, df=s.df.withColumn("n", F.col("n") + by), origin=s.origin + by, end=s.end + by, tail=max(0, s.tail - by), arrival=lambda n: s.comes(n - by))


def interleave(a: Stream, b: Stream) -> Stream:
    """Both streams' records in the order of their times; of two at one time, the right one's precedes as the maps say."""
    if a.width != b.width:
        raise ValueError("interleaved streams need equal widths")
    u, v = ratio(a.delta, b.delta)
    left = a.df.withColumn("n", F.expr(f"n + ((n + 1) * {u}L + {v - 1}L) div {v}L"))
    right = b.df.withColumn("n", F.expr(f"n + (n * {v}L) div {u}L"))
    origin = max(left_position(a.origin - 1, u, v) + 1 if a.origin else 0, right_position(b.origin - 1, u, v) + 1 if b.origin else 0)
    end = min(left_position(a.end, u, v), right_position(b.end, u, v))
    out = left.unionByName(right).where((F.col("n") >= origin) & (F.col("n") < end))
    delta = a.delta * b.delta / (a.delta + b.delta)

    def picked(n: int) -> tuple[Stream, int]:
        taken = n * v // (u + v)
        return (b, n - taken) if taken == (n + 1) * v // (u + v) else (a, taken)

    def needs(n: int) -> list:
        side, at = picked(n)
        return [(at, side.delta, side.tail)]

    def arrival(n: int) -> Fraction:
        side, at = picked(n)
        return side.comes(at)

    # u + v records take v of the left and u of the right.
    period = (u + v) * lcm(a.period // gcd(a.period, v), b.period // gcd(b.period, u))
    return Stream(out, delta, a.width, origin, end, least_tail(delta, u + v, needs), arrival, period)


def _taken(n: str, u: int, v: int) -> str:
    return f"(({n}) * {v}L) div {u + v}L"


def left_of(c: Stream, other: Fraction | str) -> Stream:
    """The left component of an interleave whose right one has interval ``other``."""
    other = Fraction(other)
    delta = component_interval(c.delta, other)
    u, v = ratio(delta, other)
    df = c.df.where(f"{_taken('n', u, v)} <> {_taken('n + 1', u, v)}").withColumn("n", F.expr(_taken("n", u, v)))
    return _picked(c, df, delta, v, lambda n: left_position(n, u, v))


def right_of(c: Stream, other: Fraction | str) -> Stream:
    """The right component of an interleave whose left one has interval ``other``."""
    other = Fraction(other)
    delta = component_interval(c.delta, other)
    u, v = ratio(other, delta)
    df = c.df.where(f"{_taken('n', u, v)} = {_taken('n + 1', u, v)}").withColumn("n", F.expr(f"n - {_taken('n', u, v)}"))
    return _picked(c, df, delta, u, lambda n: right_position(n, u, v))


def decimate(s: Stream, to: Fraction | str) -> Stream:
    """Record n is the source's at ceil(n * to / delta)."""
    to = Fraction(to)
    if to < s.delta:
        raise ValueError("the target can't be faster than the source")
    u, v = ratio(to, s.delta)
    df = s.df.withColumn("k", F.expr(f"(n * {v}L) div {u}L")).where(f"(k * {u}L + {v - 1}L) div {v}L = n").withColumn("n", F.col("k")).drop("k")
    return _picked(s, df, to, v, lambda n: cdiv(n * u, v))


def _picked(s: Stream, df: DataFrame, delta: Fraction, period: int, at: Callable[[int], int]) -> Stream:
    """A stream whose record n is that of s at ``at(n)``, which ascends."""
    tail = least_tail(delta, period, lambda n: [(at(n), s.delta, s.tail)])
    return Stream(df, delta, s.width, first_reaching(s.origin, at), first_reaching(s.end, at), tail, lambda n: s.comes(at(n)), _repeats(s, delta, period))


def _repeats(s: Stream, delta: Fraction, period: int) -> int:
    """Records after which a pattern of ``period`` records over those of s repeats, with that of s itself."""
    taken = int(period * delta / s.delta)
    return period * (s.period // gcd(s.period, taken))


def rescale(s: Stream, factor: Fraction | str) -> Stream:
    """All intervals times a factor: the records, origin, end and tail stay."""
    if Fraction(factor) <= 0:
        raise ValueError("a factor is positive")
    return replace(s, delta=s.delta * Fraction(factor), arrival=lambda n: s.comes(n) * Fraction(factor))


@contextmanager
def shared(s: Stream) -> Iterator[Stream]:
    """A stream that several results read: computed once and kept on the executors, on disk where memory ends, until the block ends."""
    kept = replace(s, df=s.df.persist())
    try:
        yield kept
    finally:
        kept.df.unpersist()


def add(a: Stream, b: Stream) -> Stream:
    """Rate-aligned join: fields of both; the faster side's index n meets floor(n * fast / slow) of the other."""
    fast, slow = min(a.delta, b.delta), max(a.delta, b.delta)
    names = [f"g{i}" for i in range(a.width)], [f"h{i}" for i in range(b.width)]
    sides, sources, bounds = [], [], []
    for s, g in zip((a, b), names, strict=True):
        u, v = ratio(fast, s.delta)
        at = (lambda n, u=u, v=v: n * u // v)
        bounds.append((first_reaching(s.origin, at), first_reaching(s.end, at), least_tail(fast, v, lambda n, at=at, s=s: [(at(n), s.delta, s.tail)])))
        sources.append((s, at, _repeats(s, fast, v)))
        renamed = s.df.select("n", *[F.col(f).alias(x) for f, x in zip(s.fields, g, strict=True)])
        # Both sides meet at the slower one's index; the faster one keeps its own as n.
        p, q = ratio(s.delta, slow)
        sides.append(renamed.withColumn("at", F.expr(f"(n * {p}L) div {q}L")))
    out = _met(a, b, sides)
    origins, ends, tails = zip(*bounds, strict=True)
    out = out.select("n", *[F.col(g).alias(f"f{i}") for i, g in enumerate([*names[0], *names[1]])])
    return Stream(out, fast, a.width + b.width, max(origins), min(ends), max(tails), lambda n: max(s.comes(at(n)) for s, at, _ in sources), lcm(*(k for _, _, k in sources)))


def _met(a: Stream, b: Stream, sides: list[DataFrame]) -> DataFrame:
    """The join of a sum's sides, in an order that doesn't depend on which one was named first: a + b and b + a are one plan, which Spark computes once."""
    if a.delta != b.delta:
        fast, slow = sides if a.delta < b.delta else sides[::-1]
        return fast.join(slow.drop("n"), "at")
    x, y = (s.drop("at") for s in sides)
    return x.join(y, "n") if a.df.semanticHash() <= b.df.semanticHash() else y.join(x, "n")


def with_constants(s: Stream, values: list[int]) -> Stream:
    """Sum with a coefficient stream of one record, which repeats."""
    df = s.df.withColumns({f"f{s.width + i}": F.lit(x).cast("long") for i, x in enumerate(values)})
    return replace(s, df=df, width=s.width + len(values))


def flattened(s: Stream) -> DataFrame:
    """(p, v): positions of single fields, n * width + i."""
    if s.width == 1:
        return s.df.select(F.col("n").alias("p"), F.col("f0").cast("long").alias("v"))
    return s.df.select("n", F.posexplode(F.array(*[F.col(f).cast("long") for f in s.fields]))).select((F.col("n") * s.width + F.col("pos")).alias("p"), F.col("col").alias("v"))


def in_buckets(df: DataFrame, step: int, length: int, bucket: int = BUCKET) -> DataFrame:
    """Rows with position p, in every bucket of output records whose windows hold them."""
    first, last = f"((p + {step - 1}L) div {step}L) div {bucket}L", f"((p + {length - 1}L) div {step}L) div {bucket}L"
    return df.withColumn("bucket", F.explode(F.expr(f"case when {first} <= {last} then sequence({first}, {last}) else array() end")))


def _windowed(s: Stream, step: int, length: int) -> Stream:
    n, delta = window_origin(s.origin, s.width, step, length), s.delta * step / s.width
    at = lambda k: k * step // s.width
    tail = least_tail(delta, s.width, lambda k: [(at(k), s.delta, s.tail)])
    return Stream(s.df, delta, 1, n, max(n, cdiv(s.end * s.width, step)), tail, lambda k: s.comes(at(k)), _repeats(s, delta, s.width))


def window(s: Stream, step: int, length: int, bucket: int = BUCKET) -> Stream:
    """Record n holds positions n * step - (L - 1) .. n * step; newest first, or oldest first for a negative length. One array field f0.

    One shuffle by ranges of the index; a record is copied to two ranges at most, not to each of its windows.
    """
    if step < 1 or length == 0:
        raise ValueError("a window needs a step of 1 or more and a length")
    size = abs(length)
    held = F.collect_list(F.struct("v")).over(Window.partitionBy("bucket").orderBy("p").rangeBetween(-(size - 1), 0))
    b = in_buckets(flattened(s), step, size, bucket).withColumn("held", held).where(f"size(held) = {size} and p % {step} = 0 and (p div {step}) div {bucket} = bucket")
    f = F.reverse("held") if length > 0 else F.col("held")
    w = _windowed(s, step, size)
    return replace(w, df=b.select(F.expr(f"p div {step}").alias("n"), F.transform(f, lambda x: x["v"]).alias("f0")).where(F.col("n") >= w.origin))


REDUCERS: dict[str, Callable[[Window], Column]] = {
    "sumc": lambda w: F.sum("v").over(w),
    "avg": lambda w: expr.saturate(expr.idiv(F.sum("v").over(w), F.count("v").over(w))),
    "min": lambda w: F.min("v").over(w),
    "max": lambda w: F.max("v").over(w),
    "count": lambda w: F.count("v").over(w),
}


def window_reduce(s: Stream, step: int, length: int, *reducers: str, bucket: int = BUCKET) -> Stream:
    """A window and reducers over it, without building its arrays: one shuffle by ranges of the index."""
    size = abs(length)
    w = Window.partitionBy("bucket").orderBy("p").rangeBetween(-(size - 1), 0)
    b = in_buckets(flattened(s), step, size, bucket)
    for i, r in enumerate(reducers):
        b = b.withColumn(f"f{i}", REDUCERS[r](w))
    b = b.withColumn("full", F.count("*").over(w)).where(f"full = {size} and p % {step} = 0 and (p div {step}) div {bucket} = bucket")
    out = _windowed(s, step, size)
    return replace(out, df=b.select(F.expr(f"p div {step}").alias("n"), *[f"f{i}" for i in range(len(reducers))]).where(F.col("n") >= out.origin), width=len(reducers))


def reduce_fields(s: Stream, reducer: str) -> Stream:
    """A reducer across the fields of each record; NULL fields are skipped."""
    f = F.array(*[F.col(x).cast("long") for x in s.fields])
    return s.select({"sumc": expr.sumc, "avg": expr.avg, "min": F.array_min, "max": F.array_max}[reducer](f))


def weighted(name: str, taps: list[float], w: Window) -> Column:
    """Sum over k of taps[k] times the value k records before."""
    terms = [F.lag(name, k).over(w) * F.lit(c) if k else F.col(name) * F.lit(c) for k, c in enumerate(taps)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def fir(s: Stream, taps: list[int], bucket: int = BUCKET) -> Stream:
    """Record n is the sum of taps[k] * x[n - k]; only full windows."""
    size = len(taps)
    w = Window.partitionBy("bucket").orderBy("p")
    b = in_buckets(flattened(s), 1, size, bucket).withColumns({"f0": weighted("v", [int(c) for c in taps], w), "old": F.lag("p", size - 1).over(w)})
    out = _windowed(s, 1, size)
    return replace(out, df=b.where(f"old is not null and p div {bucket} = bucket").select(F.col("p").alias("n"), "f0"))


def emission_times(s: Stream) -> DataFrame:
    """(n, emit_num, emit_den): record n leaves at (n + 1 + tail) * delta."""
    return s.trimmed().select("n", ((F.col("n") + 1 + s.tail) * s.delta.numerator).alias("emit_num"), F.lit(s.delta.denominator).cast("long").alias("emit_den"))


def resample(s: Stream, up: int, down: int, taps: list[float], bucket: int = BUCKET) -> Stream:
    """Polyphase rate conversion in doubles: ``up - 1`` zeros after each record, a centred filter, every ``down``-th record.

    Record o is the sum of taps[k] * x[m] over k + up * m = o * down + (len(taps) - 1) / 2; x is 0 outside the stream. Each input
    makes the outputs from itself to the next input, from its neighbours: one shuffle by ranges of the index with a halo.
    """
    if up < 1 or down < 1 or len(taps) % 2 == 0:
        raise ValueError("rates are 1 or more, and the taps' number is odd")
    half = len(taps) // 2
    reach = half // up + 1
    x = s.trimmed().select("n", F.col("f0").cast("double").alias("x"))
    x = x.withColumn("bucket", F.explode(F.expr(f"sequence(greatest(n - {reach}L, 0L) div {bucket}L, (n + {reach}L) div {bucket}L)")))
    w = Window.partitionBy("bucket").orderBy("n")
    near = lambda j: F.coalesce(F.lead("x", j).over(w) if j > 0 else F.lag("x", -j).over(w) if j else F.col("x"), F.lit(0.0))
    for r in range(up):
        # Output o = (n * up + r) / down; tap r + half - up * j meets x[n + j].
        y = sum((near(j) * F.lit(float(taps[r + half - up * j])) for j in range(-reach, reach + 1) if 0 <= r + half - up * j < len(taps)), F.lit(0.0))
        x = x.withColumn(f"y{r}", y)
    x = x.where(f"n div {bucket}L = bucket")
    outs = f"(n * {up}L + {down - 1}L) div {down}L", f"((n + 1) * {up}L + {down - 1}L) div {down}L - 1"
    x = x.select("n", F.array(*[f"y{r}" for r in range(up)]).alias("y"), F.explode(F.expr(f"if({outs[0]} <= {outs[1]}, sequence({outs[0]}, {outs[1]}), cast(array() as array<bigint>))")).alias("o"))
    df = x.select(F.col("o").alias("n"), F.get("y", (F.col("o") * down - F.col("n") * up).cast("int")).alias("f0"))
    return Stream(df, s.delta * down / up, 1, first_reaching(s.origin, lambda o: o * down // up), cdiv(s.end * up, down), s.tail)


def provenance(s: Stream, field: str = "f0", unit: int = 1_000_000) -> DataFrame:
    """(n, source, record, place) that the values of tagged sources, (source + 1) * unit + record * 10 + place, tell of themselves."""
    return s.trimmed().select("n", F.expr(f"{field} div {unit}L - 1").alias("source"), F.expr(f"{field} % {unit}L div 10").alias("record"), F.expr(f"{field} % 10").alias("place"))


def canonical_long(s: Stream, family: str, variant: str) -> DataFrame:
    """(family, variant, logical_index, field_name, value, is_null, is_gap), a row per field."""
    pairs = F.array(*[F.struct(F.lit(f"out_{i}").alias("field_name"), F.col(f).cast("string").alias("value")) for i, f in enumerate(s.fields)])
    x = s.trimmed().select("n", F.explode(pairs).alias("x"))
    return x.select(F.lit(family).alias("family"), F.lit(variant).alias("variant"), F.col("n").alias("logical_index"), "x.field_name", "x.value", F.col("x.value").isNull().cast("int").alias("is_null"), F.lit(0).alias("is_gap"))
