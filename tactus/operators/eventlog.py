"""Events in measurement logs: tails, gaps, coincidences, periodic positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .measure import at_rank, joined, medians, middle, placed


def tail_events(df: DataFrame, metric: str, threshold: int, rate: int) -> DataFrame:
    return df.where(F.col(metric) >= threshold).withColumn("at_s", F.col("iter") / rate)


def event_gaps(df: DataFrame, role: str, order: str, bucket: int = 100_000) -> DataFrame:
    """(role, least, median, largest) gap between consecutive events: within buckets of ``order``, and between those that have events."""
    b = df.where(F.col(order).isNotNull()).select(role, F.col(order).alias("at_"), F.floor(F.col(order) / bucket).alias("bucket_"))
    inner = b.withColumn("gap", F.col("at_") - F.lag("at_").over(Window.partitionBy(role, "bucket_").orderBy("at_"))).select(role, "gap")
    ends = b.groupBy(role, "bucket_").agg(F.min("at_").alias("lo_"), F.max("at_").alias("hi_"))
    outer = ends.withColumn("gap", F.col("lo_") - F.lag("hi_").over(Window.partitionBy(role).orderBy("bucket_"))).select(role, "gap")
    g = inner.unionByName(outer).where("gap is not null")
    return placed(g, role, "gap").groupBy(role).agg(F.min("gap").alias("least"), middle("gap").alias("median"), F.max("gap").alias("largest"))


def coincidence(a: DataFrame, b: DataFrame, time: str, tolerance: int) -> DataFrame:
    """Rows of a with any row of b within the tolerance, each once.

    Slots are as wide as the tolerance: any event of b in a row's own slot is near enough, and of the slots beside it only the last
    event before and the first one after matter. So b comes down to three rows a slot before the join, however many events it has there.
    """
    t, slot = F.col(time).cast("long"), F.expr(f"(cast({time} as long) - pmod(cast({time} as long), {tolerance}L)) div {tolerance}L")
    of = b.where(F.col(time).isNotNull()).groupBy(slot.alias("slot_")).agg(F.min(t).alias("lo_"), F.max(t).alias("hi_"))
    none = F.lit(None).cast("long")
    near = F.array(*[F.struct((F.col("slot_") + k).alias("slot_"), F.lit(k == 0).alias("own_"), (F.col("hi_") if k == 1 else none).alias("before_"), (F.col("lo_") if k == -1 else none).alias("after_")) for k in (-1, 0, 1)])
    of = of.select(F.inline(near)).groupBy("slot_").agg(F.bool_or("own_").alias("own_"), F.max("before_").alias("before_"), F.min("after_").alias("after_"))
    hit = F.col("own_") | F.coalesce(t - F.col("before_") <= tolerance, F.lit(False)) | F.coalesce(F.col("after_") - t <= tolerance, F.lit(False))
    return a.withColumn("slot_", slot).join(of, "slot_").where(hit).select(*a.columns)


def coincidence_report(a: DataFrame, b: DataFrame, time: str, tolerance: int, first: int, last: int) -> DataFrame:
    """One row: events on each side in [first, last], coincident ones, and a verdict by their presence."""
    inside = F.col(time).between(first, last)
    a, b = a.where(inside), b.where(inside)
    n = a.agg(F.count("*").alias("events_a")).withColumn("one", F.lit(1)).join(b.agg(F.count("*").alias("events_b")).withColumn("one", F.lit(1)), "one").join(coincidence(a, b, time, tolerance).agg(F.count("*").alias("coincident")).withColumn("one", F.lit(1)), "one").drop("one")
    verdict = F.when((F.col("events_a") == 0) & (F.col("events_b") == 0), "none").when(F.col("events_b") == 0, "only_a").when(F.col("events_a") == 0, "only_b").when(F.col("coincident") > 0, "shared").otherwise("independent")
    return n.withColumn("verdict", verdict)


def phase_profile(df: DataFrame, period: int, metric: str) -> DataFrame:
    x = df.withColumn("phase", F.pmod("iter", F.lit(period)).cast("long"))
    return joined(x.groupBy("phase").agg(F.count("*").alias("n"), F.max(metric).alias("largest")), medians(x, ["phase"], metric), ["phase"])


def phase_excess(df: DataFrame, period: int, metric: str) -> DataFrame:
    """One row: the median at the last position of a period, that of all, and the difference."""
    edge = F.pmod("iter", F.lit(period)) == period - 1
    rows = F.inline(F.array(F.struct(F.lit("all").alias("part_")), F.struct(F.when(edge, "edge").alias("part_"))))
    p = placed(df.select(F.col(metric).alias("value_"), rows).where("part_ is not null"), "part_", "value_")
    of = lambda part, k: at_rank("value_", F.when(F.col("part_") == part, F.expr(k)))
    m = {part: ((of(part, "(size - 1) div 2") + of(part, "size div 2")) / 2).cast("double") for part in ("edge", "all")}
    return p.agg(m["edge"].alias("edge_median"), m["all"].alias("median")).withColumn("excess", F.col("edge_median") - F.col("median"))
