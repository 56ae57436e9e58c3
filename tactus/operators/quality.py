"""Checks of streams and of tables of results. Every comparison reports how much it compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.operators.streams import Stream

NULL_FILL = 2


def null_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: records with all fields, with some, with none."""
    nulls = sum((F.col(c).isNull().cast("int") for c in fields), F.lit(0))
    return df.agg(F.count_if(nulls == 0).alias("present"), F.count_if((nulls > 0) & (nulls < len(fields))).alias("partial_null"), F.count_if(nulls == len(fields)).alias("all_null"))


def runs(df: DataFrame, where: Column, bucket: int = 100_000, fan: int = 1_000) -> DataFrame:
    """(first, length) of each run of consecutive n for which ``where`` holds.

    Islands per bucket; pieces that touch a bucket's edge may go on and are joined per ``fan`` buckets, then per ``fan`` of those.
    What is left for one task are two pieces at most for each range of bucket * fan * fan records.
    """
    hit = df.where(where).select("n").withColumn("bucket", F.expr(f"n div {bucket}L"))
    part = hit.withColumn("g", F.col("n") - F.row_number().over(Window.partitionBy("bucket").orderBy("n"))).groupBy("bucket", "g").agg(F.min("n").alias("first"), F.max("n").alias("last")).select("first", "last")
    done = None
    for size, above in ((bucket, bucket * fan), (bucket * fan, bucket * fan * fan), (bucket * fan * fan, None)):
        edge = f"first % {size}L = 0 or last % {size}L = {size - 1}L"
        ready = part.where(f"not ({edge})")
        done = ready if done is None else done.unionByName(ready)
        e = part.where(edge).withColumn("range", F.expr(f"first div {above}L") if above else F.lit(0))
        w = Window.partitionBy("range").orderBy("first") if above else Window.orderBy("first")
        e = e.withColumn("new", (F.col("first") != F.coalesce(F.lag("last").over(w), F.lit(-2)) + 1).cast("int")).withColumn("run", F.sum("new").over(w))
        part = e.groupBy("range", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
    return done.unionByName(part).select("first", (F.col("last") - F.col("first") + 1).alias("length"))


def stream_compare(a: DataFrame, b: DataFrame, first: int, span: int, field: str = "f0") -> DataFrame:
    """One row over [first, first + span): compared, mismatches, missing records, and the first difference with both values."""
    inside = F.col("n").between(first, first + span - 1)
    x = a.where(inside).select("n", F.col(field).alias("a"), F.lit(True).alias("in_a"))
    y = b.where(inside).select("n", F.col(field).alias("b"), F.lit(True).alias("in_b"))
    j = x.join(y, "n", "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    bad = ~both | ~F.col("a").eqNullSafe(F.col("b"))
    return j.agg(F.count_if(both).alias("compared"), F.count_if(both & bad).alias("mismatches"), (F.lit(span) - F.count_if(both)).cast("long").alias("missing"), F.min(F.when(bad, F.col("n"))).alias("first_bad"), F.min_by("a", F.when(bad, F.col("n"))).alias("first_a"), F.min_by("b", F.when(bad, F.col("n"))).alias("first_b"))


def record_compare(a: Stream, b: Stream, first: int | None = None, span: int | None = None) -> DataFrame:
    """One row over [first, first + span): are whole records equal, and where is the first difference.

    first: the greater tail of the two by default; span: up to the earlier end. Columns: compared, mismatches, missing, equal, first_n,
    first_position, first_a, first_b. An index without a record on either side is a failure, with a NULL position, and so is a
    record of another width; nothing compared is a failure, too. Records are compared as arrays, without a row per field.
    """
    first = max(a.tail, b.tail) if first is None else first
    span = max(0, min(a.end, b.end) - first) if span is None else span
    inside = F.col("n").between(first, first + span - 1)
    side = lambda s, name: s.df.where(inside).select("n", F.array(*[F.col(f).cast("string") for f in s.fields]).alias(name))
    j = side(a, "a").join(side(b, "b"), "n", "full")
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    # The first position at which the arrays differ; the shorter one's end counts.
    at = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    width = F.when(F.size("a") != F.size("b"), F.least(F.size("a"), F.size("b")) + 1)
    place = F.when(there, F.least(F.nullif(at.cast("int"), F.lit(0)), width) - 1)  # least skips NULL
    bad = ~there | place.isNotNull()
    row = F.struct("n", place.cast("long").alias("place"), F.get("a", place.cast("int")).alias("x"), F.get("b", place.cast("int")).alias("y"))
    one = j.agg(F.count_if(there).alias("compared"), F.count_if(there & bad).alias("mismatches"), F.min(F.when(bad, row)).alias("d"))
    # Indexes that neither side has: the first one is where the indexes of what is there stop being dense.
    lost = first_hole(j.select("n"), first, span)
    one = one.withColumn("k_", F.lit(1)).join(lost.withColumn("k_", F.lit(1)), "k_")  # one row each
    hole = F.col("hole").isNotNull() & (F.col("d").isNull() | (F.col("hole") < F.col("d.n")))
    pick = lambda c: F.when(~hole, F.col(f"d.{c}"))
    missing = (F.lit(span) - F.col("compared")).cast("long")
    return one.select("compared", "mismatches", missing.alias("missing"), ((F.col("compared") > 0) & (F.col("mismatches") == 0) & (missing == 0)).alias("equal"), F.when(hole, F.col("hole")).otherwise(F.col("d.n")).alias("first_n"), pick("place").alias("first_position"), pick("x").alias("first_a"), pick("y").alias("first_b"))


def first_hole(rows: DataFrame, first: int, span: int, bucket: int = 100_000) -> DataFrame:
    """(hole): one row, the first index of [first, first + span) that no row has, or NULL. Buckets are counted; only one that lacks rows is looked into."""
    at = rows.select(F.col("n"), F.expr(f"(n - {first}L) div {bucket}L").alias("bucket")).distinct()
    full = at.groupBy("bucket").agg(F.count("*").alias("k"))
    buckets = -(-span // bucket)
    every = rows.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(full, "bucket", "left")
    size = F.least(F.lit(bucket), F.lit(span) - F.col("bucket") * bucket)
    lack = every.where(F.coalesce("k", F.lit(0)) < size).agg(F.min("bucket").alias("bucket"))
    here = lack.join(at, "bucket", "left").groupBy("bucket").agg(F.collect_list("n").alias("n"))
    start = F.lit(first) + F.col("bucket") * bucket
    hole = F.element_at(F.array_except(F.sequence(start, F.least(start + bucket, F.lit(first + span)) - 1), "n"), 1)
    return here.select(F.when(F.col("bucket").isNotNull(), hole).alias("hole"))


def observation_diff(a: Stream, b: Stream, materialised: tuple | None = None) -> DataFrame:
    """(layer, compared, differences) of two observed streams: interval, span, tail, schema, records and gaps.

    Records are compared where both have one, gaps (indexes without a record) where either has one. ``materialised``: how each is
    kept (None: not at all; else its artifact's descriptor), which adds that layer: kept both or neither, and with equal names and types of fields.
    """
    kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s.df.select(*s.fields).schema]
    heads = [("interval", a.delta == b.delta), ("span", (a.origin, a.end) == (b.origin, b.end)), ("tail", a.tail == b.tail), ("schema", kinds(a) == kinds(b))]
    if materialised is not None:
        x, y = (None if d is None else (list(d.names), list(d.types)) for d in materialised)
        heads.append(("materialisation", x == y))
    side = lambda s, name: s.trimmed().select("n", F.array(*[F.col(f).cast("string") for f in s.fields]).alias(name))
    j = side(a, "a").join(side(b, "b"), "n", "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    row = j.agg(F.count_if(both).alias("common"), F.count_if(both & ~F.col("a").eqNullSafe(F.col("b"))).alias("unequal"), F.count("*").alias("every"), F.count_if(~both).alias("alone"))
    layer = lambda name, compared, differences: F.struct(F.lit(name).alias("layer"), compared.cast("long").alias("compared"), differences.cast("long").alias("differences"))
    layers = [layer(name, F.lit(1), F.lit(int(not same))) for name, same in heads]
    return row.select(F.inline(F.array(*layers, layer("records", F.col("common"), F.col("unequal")), layer("gaps", F.col("every"), F.col("alone")))))


def corpus_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(status, n): identical, changed, only_left, only_right."""
    a, b = left.select(key, F.col(value).alias("a"), F.lit(1).alias("l")), right.select(key, F.col(value).alias("b"), F.lit(1).alias("r"))
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.col("a").eqNullSafe(F.col("b")), "identical").otherwise("changed")
    return a.join(b, key, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def status_transitions(before: DataFrame, after: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """(before, after, n, kind): kind by the order of statuses, worst first."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    j = before.select(key, F.col(status).alias("before")).join(after.select(key, F.col(status).alias("after")), key)
    kind = F.when(rank("after") > rank("before"), "improvement").when(rank("after") < rank("before"), "regression").otherwise("same")
    return j.groupBy("before", "after").agg(F.count("*").alias("n")).withColumn("kind", kind)


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, problem): keys of one side only, and keys whose values disagree."""
    x, y = a.select(key, F.col(value).alias("va")), b.select(key, F.col(value).alias("vb"))
    one = lambda p, q, name: p.join(q, key, "left_anti").select(key, F.lit(name).alias("problem"))
    return one(x, y, "only_a").unionByName(one(y, x, "only_b")).unionByName(x.join(y, key).where(~F.col("va").eqNullSafe(F.col("vb"))).select(key, F.lit("differs").alias("problem")))


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tuples of one side only, with the side."""
    return a.exceptAll(b).distinct().withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("b")))


def inconsistent(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, variants): groups in which the values aren't one and the same."""
    return df.groupBy(*by).agg(F.count_distinct(F.struct(*values)).alias("variants"), F.count("*").alias("checked")).where("variants > 1")


def consistency(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row: groups checked, those whose values aren't one and the same, and whether that is well. Nothing checked is an error."""
    g = df.groupBy(*by).agg(F.min(F.struct(*values)).alias("lo"), F.max(F.struct(*values)).alias("hi"))
    return g.agg(F.count("*").alias("checked"), F.count_if(F.col("lo") != F.col("hi")).alias("problems")).withColumn("ok", (F.col("checked") > 0) & (F.col("problems") == 0))


def set_difference_counts(df: DataFrame, case: str, node: str, profile: str, before: str, after: str, failed: Column) -> DataFrame:
    """(case, added, removed, net) of the nodes under two profiles; cases that fail under any are left out."""
    bad = df.where(failed).select(case).distinct()
    d = df.join(bad, case, "left_anti").groupBy(case, node).agg(F.max((F.col(profile) == before).cast("int")).alias("x"), F.max((F.col(profile) == after).cast("int")).alias("y"))
    return d.groupBy(case).agg(F.count_if(F.col("y") > F.col("x")).alias("added"), F.count_if(F.col("x") > F.col("y")).alias("removed"), F.sum(F.col("y") - F.col("x")).alias("net"))


def expected_check(observed: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value isn't the expected one; a NULL expectation accepts any."""
    return observed.join(expected, key).where(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col(value))).select(key, value, "expected")


def checksum(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(by, rows, digest): a digest of each group's rows that doesn't depend on their order."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in fields])), 1, 8), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row).alias("digest"), F.bit_xor(row).alias("mixed"))
