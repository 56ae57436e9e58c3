"""Inference: bootstrap ratios, least squares, differenced counters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .measure import placed

REPLICATES = 10_000


def median_places(n: int, replicates: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places, in n sorted values, of the two middle values of bootstrap samples.

    A sample's places are floor(n * u) of n uniform u, so its middle values lie at the middle order statistics of the u's,
    which are drawn as such (beta distributed): the same distribution as that of whole samples, at a cost apart from n.
    """
    u = rng.beta((n + 1) // 2, n - (n + 1) // 2 + 1, replicates)
    low = high = np.minimum((n * u).astype(np.int64), n - 1)
    if n % 2 == 0:
        high = np.minimum((n * (u + (1 - u) * rng.beta(1, n // 2, replicates))).astype(np.int64), n - 1)
    return low, high


def resampled_medians(xs: np.ndarray, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """Medians of bootstrap samples of the sorted xs."""
    low, high = median_places(len(xs), replicates, rng)
    return (xs[low] + xs[high]) / 2.0


def bounds(replicates: np.ndarray) -> tuple[float, float]:
    """95 % interval of sorted replicates: those at floor(0.025 * (R - 1)) and floor(0.975 * (R - 1))."""
    return float(replicates[int(0.025 * (len(replicates) - 1))]), float(replicates[int(0.975 * (len(replicates) - 1))])


def _seeded(seed: int, key, i: int) -> np.random.Generator:
    """Draws depend on seed, case and group alone, so reruns agree."""
    return np.random.default_rng([seed, int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest()), i])


def _values_at_places(df: DataFrame, case: str, group: str, metric: str, groups: tuple[str, ...], replicates: int, seed: int) -> DataFrame:
    """(case, i, size, before, value) of group i of a case: its values, each with the number of lesser ones.

    Values are counted and their counts summed up in ranges, so that no task sorts a group. Of a group of more than 2 * replicates
    values only those at places that are drawn are left, which are no more: drawn places and values meet in short spans of places.
    """
    number = F.coalesce(*[F.when(F.col(group) == g, F.lit(i)) for i, g in enumerate(groups)])
    rows = df.where(F.col(group).isin(*groups)).select(F.struct(F.col(case), number.alias("i")).alias("group_"), F.col(metric).cast("double").alias("value_"))
    p = placed(rows, "group_", "value_").select(F.col(f"group_.{case}").alias(case), F.col("group_.i").alias("i"), "size", "before", "n", F.col("value_").alias("value"))
    few = 2 * replicates
    large = p.where(F.col("size") > few)
    sizes = large.groupBy(case, "i").agg(F.max("size").alias("size"))
    drawn = StructType([p.schema[case], p.schema["i"], StructField("span", LongType()), StructField("place", LongType())])

    def draw(batches):
        for batch in batches:
            for key, i, size in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                places = np.unique(np.concatenate([*median_places(size, replicates, _seeded(seed, key, i)), [(size - 1) // 2, size // 2]]))
                out = [pa.array([key] * len(places), batch.column(0).type), pa.array(np.full(len(places), i, np.int32)), pa.array(places // _span(size)), pa.array(places)]
                yield pa.RecordBatch.from_arrays(out, drawn.names)

    spans = large.withColumn("width", F.floor(F.sqrt("size") / 16) + 1).withColumn("span", F.explode(F.expr("sequence(before div width, (before + n - 1) div width)")))
    places = sizes.mapInArrow(draw, drawn).withColumnsRenamed({case: "case_", "i": "i_", "span": "span_"})
    at = spans[case].eqNullSafe(F.col("case_")) & (spans["i"] == F.col("i_")) & (spans["span"] == F.col("span_")) & F.col("place").between(F.col("before"), F.col("before") + F.col("n") - 1)
    kept = spans.join(places, at).select(case, "i", "size", "before", "value").distinct()
    return p.where(F.col("size") <= few).select(case, "i", "size", "before", "value").unionByName(kept)


def _span(size: int) -> int:
    """Places that one span holds: some hundred spans for the width in which a large group's medians lie."""
    return int(math.sqrt(size) / 16) + 1


def _bootstrapped(df: DataFrame, case: str, group: str, metric: str, groups: tuple[str, ...], replicates: int, seed: int, names: tuple[str, ...], finish: Callable) -> DataFrame:
    """(case, names): ``finish`` over each case's medians, (point, replicates) by group or None where it has no value; a case's rows are at most 2 * replicates a group."""
    values = _values_at_places(df, case, group, metric, groups, replicates, seed)
    schema = StructType([df.schema[case], *[StructField(c, DoubleType()) for c in names]])

    def of(table: pa.Table) -> pa.Table:
        key, cols = table.column(case)[0].as_py(), {c: table.column(c).to_numpy() for c in ("i", "size", "before", "value")}
        found = []
        for i in range(len(groups)):
            rows = np.flatnonzero(cols["i"] == i)
            if not len(rows):
                found.append(None)
                continue
            rows = rows[np.argsort(cols["before"][rows])]
            size, before, value = int(cols["size"][rows[0]]), cols["before"][rows], cols["value"][rows]
            at = lambda places, before=before, value=value: value[np.searchsorted(before, places, "right") - 1]
            low, high = median_places(size, replicates, _seeded(seed, key, i))
            middle = at(np.array([(size - 1) // 2, size // 2]))
            found.append((float(middle.mean()), (at(low) + at(high)) / 2.0))
        out = finish(found)
        rows = [] if out is None else [(key, *out)]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], table.schema.field(case).type), *[pa.array([r[k + 1] for r in rows], pa.float64()) for k in range(len(names))]], schema.names)

    return values.groupBy(case).applyInArrow(of, schema)


def bootstrap_ratio(df: DataFrame, case: str, profile: str, metric: str, top: str, bottom: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(case, ratio, lo, hi): ratio of two profiles' medians with the nearest-rank 95 % interval of its replicates.

    Cells may have any number of repetitions: only the values at drawn places come together.
    """

    def finish(found: list) -> tuple | None:
        a, b = found
        if b is None or b[0] == 0:
            return None
        if a is None:
            return None, None, None
        x, y = a[1], b[1]
        r = np.sort(x[y != 0] / y[y != 0])
        return (a[0] / b[0], *bounds(r)) if len(r) else None

    return _bootstrapped(df, case, profile, metric, (top, bottom), replicates, seed, ("ratio", "lo", "hi"), finish)


def bootstrap_difference(df: DataFrame, case: str, group: str, metric: str, groups: tuple[str, str, str, str], replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(case, diff, lo, hi): median(a) / median(b) - median(c) / median(d) of four groups, with the interval of its replicates.

    Cases without a value in each group, or with a zero median below, are left out.
    """

    def finish(found: list) -> tuple | None:
        if any(f is None for f in found) or found[1][0] == 0 or found[3][0] == 0:
            return None
        (a, x), (b, y), (c, z), (d, w) = found
        ok = (y != 0) & (w != 0)
        r = np.sort(x[ok] / y[ok] - z[ok] / w[ok])
        return (a / b - c / d, *bounds(r)) if len(r) else None

    return _bootstrapped(df, case, group, metric, groups, replicates, seed, ("diff", "lo", "hi"), finish)


def classify(ratio: Column, lo: Column, hi: Column, threshold: float = 0.1) -> Column:
    """A: better by the threshold and surely better; C: worse by it and surely worse; B: neither."""
    return F.when((ratio <= 1 - threshold) & (hi < 1), "A").when((ratio >= 1 + threshold) & (lo > 1), "C").otherwise("B")


def least_squares(df: DataFrame, xs: list[str], y: str) -> list[float]:
    """Coefficients without intercept from the normal equations; one aggregate, solved on the driver for up to four."""
    k = len(xs)
    row = df.agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)], *[F.sum(F.col(a).cast("double") * F.col(y)).alias(f"r{i}") for i, a in enumerate(xs)]).first()
    m = [[row[f"g{i}_{j}"] for j in range(k)] + [row[f"r{i}"]] for i in range(k)]
    if any(v is None for r in m for v in r):
        raise ValueError("no rows to fit")
    for i in range(k):
        top = max(range(i, k), key=lambda r: abs(m[r][i]))
        if abs(m[top][i]) < 1e-12 * max(1.0, abs(m[i][i])):
            raise ValueError("the features are linearly dependent")
        m[i], m[top] = m[top], m[i]
        for r in range(k):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [a - f * b for a, b in zip(m[r], m[i], strict=True)]
    return [m[i][k] / m[i][i] for i in range(k)]


def mare(df: DataFrame, group: str, predicted: Column, actual: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(predicted - actual) / F.abs(actual)), 9).alias("mare"))


def feature_join(targets: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join; raises if a target has no features."""
    if not targets.join(features, keys, "left_anti").isEmpty():
        raise ValueError("a target has no features")
    return targets.join(features, keys)


def equivalence(df: DataFrame, case: str, margin: float = 0.02) -> DataFrame:
    """df: (case, cell, diff, lo, hi). A verdict a cell: inside +-margin no effect, outside an effect; and the roll-up."""
    v = F.when((F.col("lo") > -margin) & (F.col("hi") < margin), "no_effect").when((F.col("lo") > margin) | (F.col("hi") < -margin), "effect").otherwise("undecided")
    d = df.withColumn("verdict", v)
    return d.groupBy(case).agg(F.count("*").alias("cells"), F.bool_and(F.col("verdict") == "no_effect").alias("none"), F.bool_or(F.col("verdict") == "effect").alias("any_effect"))


def counter_rate(df: DataFrame, case: str, level: str, counter: str, low: int, high: int) -> DataFrame:
    """(case, rate, is_error): (W(high) - W(low)) / (high - low); a negative difference is an error."""
    w = df.groupBy(case).agg(F.sum(F.when(F.col(level) == high, F.col(counter))).alias("hi"), F.sum(F.when(F.col(level) == low, F.col(counter))).alias("lo")).where("hi is not null and lo is not null")
    return w.select(case, ((F.col("hi") - F.col("lo")) / float(high - low)).alias("rate"), (F.col("hi") < F.col("lo")).alias("is_error"))
