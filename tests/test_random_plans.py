"""Random plans of stream operators beside their definitions, record by record: values, first and last indexes, arrivals and tails."""

import random
from fractions import Fraction
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from tactus.operators import streams as S

INTERVALS = ["1/10", "1/5", "3/10", "147/1000", "1/4", "2/9", "1", "3/7", "1/360"]


class Model:
    """A stream by definition: at(n) is record n, or None where it doesn't exist; there(n) the time at which it does."""

    def __init__(self, delta, width, at, there):
        self.delta, self.width, self.at, self.there = delta, width, at, there


def source(spark, r, number):
    delta, width, count = Fraction(r.choice(INTERVALS)), r.randint(1, 3), r.randint(25, 60)
    fields = [F.expr(f"if(id % {r.choice([7, 11, 1000])} = 3, null, {number + 1} * 100000 + id * 10 + {i})") for i in range(width)]
    rows = {q.n: tuple(q[1:]) for q in spark.range(count).select(F.col("id").alias("n"), *fields).collect()}
    return S.from_table(spark.range(count), "id", fields, delta), Model(delta, width, rows.get, lambda n: (n + 1) * delta)


def shifted(x, m, by):
    return S.shift(x, by), Model(m.delta, m.width, lambda n: m.at(n - by), lambda n: m.there(n - by))


def interleaved(x, y, a, b):
    z = b.delta / (a.delta + b.delta)

    def picked(n):
        k = floor(z * n)
        return (b, n - k) if k == floor(z * (n + 1)) else (a, k)

    return S.interleave(x, y), Model(a.delta * b.delta / (a.delta + b.delta), a.width, lambda n: picked(n)[0].at(picked(n)[1]) if n >= 0 else None, lambda n: picked(n)[0].there(picked(n)[1]))


def gathered(x, m, delta, index):
    return x, Model(delta, m.width, lambda n: m.at(index(n)) if n >= 0 else None, lambda n: m.there(index(n)))


def left(x, m, other):
    delta = m.delta * other / abs(m.delta - other)
    return gathered(S.left_of(x, other), m, delta, lambda n: n + ceil((n + 1) * delta / other))


def right(x, m, other):
    delta = m.delta * other / abs(m.delta - other)
    return gathered(S.right_of(x, other), m, delta, lambda n: n + floor(n * delta / other))


def decimated(x, m, to):
    return gathered(S.decimate(x, to), m, to, lambda n: ceil(n * to / m.delta))


def summed(x, y, a, b):
    fast = min(a.delta, b.delta)
    side = lambda m, n: floor(n * fast / m.delta)

    def at(n):
        p, q = a.at(side(a, n)), b.at(side(b, n))
        return None if n < 0 or p is None or q is None else p + q

    return S.add(x, y), Model(fast, a.width + b.width, at, lambda n: max(a.there(side(a, n)), b.there(side(b, n))))


def windowed(x, m, step, length, reducer):
    def at(n):
        if n * step < length - 1:
            return None
        rows = [(m.at(p // m.width), p % m.width) for p in range(n * step - length + 1, n * step + 1)]
        if any(row is None for row, _ in rows):
            return None
        v = [row[i] for row, i in rows if row[i] is not None]
        if not v:
            return (None,)
        return ({"sumc": sum(v), "avg": min(sum(v) // len(v), 2**31 - 1), "min": min(v), "max": max(v)}[reducer],)

    return S.window_reduce(x, step, length, reducer, bucket=16), Model(m.delta * step / m.width, 1, at, lambda n: m.there(n * step // m.width))


def reduced(x, m):
    def at(n):
        row = m.at(n)
        v = [c for c in row or () if c is not None]
        return row and (max(v, default=None),)

    return S.reduce_fields(x, "max"), Model(m.delta, 1, at, m.there)


def plan(spark, r, depth):
    if depth == 0:
        return source(spark, r, r.randint(0, 5))
    kind = r.choice(["shift", "interleave", "left", "right", "decimate", "add", "window", "reduce"])
    x, m = plan(spark, r, depth - 1)
    if kind in ("interleave", "left", "right", "add"):
        y, b = plan(spark, r, r.randint(0, depth - 1))
        if kind == "add":
            return summed(x, y, m, b)
        if m.width != b.width:
            (x, m), (y, b) = reduced(x, m), reduced(y, b)
        a = m
        x, m = interleaved(x, y, a, b)
        return (x, m) if kind == "interleave" else left(x, m, b.delta) if kind == "left" else right(x, m, a.delta)
    if kind == "shift":
        return shifted(x, m, r.randint(1, 9))
    if kind == "decimate":
        return decimated(x, m, m.delta * Fraction(r.randint(5, 12), 5))
    if kind == "window":
        return windowed(x, m, r.randint(1, 5), r.randint(1, 8), r.choice(["sumc", "avg", "min", "max"]))
    return reduced(x, m)


@pytest.mark.parametrize("seed", range(14))
def test_plan_equals_its_definition(spark, seed):
    r = random.Random(seed)
    x, m = plan(spark, r, 1 + seed % 4)
    assert (x.delta, x.width) == (m.delta, m.width)
    got = {q.n: tuple(q[f] for f in x.fields) for q in x.trimmed().collect()}
    span = range(x.origin, x.end)
    assert got == {n: m.at(n) for n in span}
    # No record is missing from the first index on, and none is there just before it.
    assert all(m.at(n) is not None for n in span)
    assert not len(span) or x.origin == 0 or m.at(x.origin - 1) is None
    for n in range(x.origin, x.origin + 40):
        assert x.comes(n) == m.there(n) <= (n + 1 + x.tail) * x.delta
        assert x.comes(n + x.period) - x.comes(n) == x.period * x.delta
