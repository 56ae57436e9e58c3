"""Integer index maps of regular streams: plain arithmetic on intervals, for the driver."""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction


def cdiv(a: int, b: int) -> int:
    return -(-a // b)


def ratio(a: Fraction, b: Fraction) -> tuple[int, int]:
    """a / b as (U, V) in lowest terms."""
    r = Fraction(a) / Fraction(b)
    return r.numerator, r.denominator


def left_position(k: int, u: int, v: int) -> int:
    """Where record k of the left stream stands in an interleave; U / V is the ratio of intervals."""
    return k + cdiv((k + 1) * u, v)


def right_position(j: int, u: int, v: int) -> int:
    return j + j * v // u


def component_interval(c: Fraction, other: Fraction) -> Fraction:
    """Interval of the component that, interleaved with one of interval ``other``, gives interval c."""
    if c == other:
        raise ValueError("the component's interval must differ from the stream's")
    if other < c:
        raise ValueError("a component can't be faster than the stream")
    return c * other / abs(c - other)


def window_origin(origin: int, width: int, step: int, length: int) -> int:
    return cdiv(origin * width + length - 1, step)


def first_reaching(target: int, position) -> int:
    """Least n >= 0 whose source index position(n) is target or more; position ascends."""
    return bisect_left(range(1 << 62), target, key=position)


def least_tail(delta: Fraction, period: int, needs) -> int:
    """Least W >= 0 with which record n, emitted at (n + 1 + W) * delta, never precedes a record that it needs.

    needs(n): (index, interval, tail) of each; what it asks for repeats with ``period`` records.
    """
    worst = 0
    for n in range(period):
        for index, interval, tail in needs(n):
            r = (index + 1 + tail) * Fraction(interval) / delta
            worst = max(worst, cdiv(r.numerator, r.denominator) - 1 - n)
    return worst
