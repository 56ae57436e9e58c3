"""Field expressions with the streams' integer semantics; NULL absorbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def idiv(a: Column | str, b: Column | str | int) -> Column:
    """Integer quotient, truncated toward zero; NULL for a zero divisor."""
    b = F.lit(b) if isinstance(b, int) else F.col(b) if isinstance(b, str) else b
    a = F.col(a) if isinstance(a, str) else a
    b = F.nullif(b.cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", a.cast("long"), b)


def saturate(x: Column) -> Column:
    """Clamped to 32 bits."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(INT_MAX)), F.lit(INT_MIN))).cast("long")


def out_of_range(x: Column) -> Column:
    return F.coalesce((x > INT_MAX) | (x < INT_MIN), F.lit(False))


def zip_fields(a: Column, b: Column, op) -> Column:
    """Element-wise op of two records' fields by position."""
    return F.zip_with(a, b, op)


def present(f: Column) -> Column:
    return F.filter(f, lambda x: x.isNotNull())


def sumc(f: Column) -> Column:
    """Sum of the fields that aren't NULL; NULL if none is."""
    p = present(f)
    return F.when(F.size(p) > 0, F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x))


def avg_pair(f: Column) -> Column:
    """Exact average as a fraction (num, den), not reduced; NULL if no field is present."""
    return F.when(F.size(present(f)) > 0, F.struct(sumc(f).alias("num"), F.size(present(f)).cast("long").alias("den")))


def avg(f: Column) -> Column:
    """Average truncated toward zero over the fields that aren't NULL."""
    return saturate(idiv(sumc(f), F.size(present(f))))


PROMOTION = ("byte", "integer", "uint", "rational", "float", "double")


def promoted(a: str, b: str) -> str:
    return max(a, b, key=PROMOTION.index)


def promote(x: Column, kind: str) -> Column:
    if kind == "rational":
        return F.struct(x.cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    return x.cast({"byte": "short", "integer": "long", "uint": "long", "float": "float", "double": "double"}[kind])


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs, 0 for two zeros: Euclid's steps, as many as 64 bits can take."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0).cast("long"))).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def rational(num: Column, den: Column) -> Column:
    """(num, den) in lowest terms with a positive denominator; NULL for a zero denominator."""
    num, den = num.cast("long"), den.cast("long")
    g = gcd(num, den) * F.signum(den).cast("long")
    lowest = F.struct(F.call_function("div", num, F.nullif(g, F.lit(0).cast("long"))).alias("num"), F.call_function("div", den, F.nullif(g, F.lit(0).cast("long"))).alias("den"))
    return F.when(num.isNotNull() & (den != 0), lowest)


def radd(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def rsub(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def rmul(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["num"], a["den"] * b["den"])


def rdiv(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"], a["den"] * b["num"])
