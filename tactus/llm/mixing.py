"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 3, 1, 2, 3, ... and share 1.5 times all words; no target exceeds
twice its source's words, and what it would have had above that is shared again by weight.

Rates: among all document rates r in [0, 2], those closest to 1 in (binary) relative entropy that meet a source's token
constraint are r = 2 / (1 + exp(-lambda * size / mean)): documents are tilted exponentially by their size. lambda, one a
source, solves a convex dual; Newton's method finds it. Each iteration is one distributed aggregate of gradient and
curvature over (source, size, count), a lossless summary of the documents.

Rounding: within a source, documents ordered by size get whole copies by systematic rounding, whose token error is at
most the size of one document; the rest is taken as part of a copy from documents that still have room. Running sums over a source
are taken in two levels, over ranges of sizes and within each, in whole units of 2**-20 copies, so that no task holds a
source and sums don't depend on their order: reruns agree.

Defined results: null texts have size 0 and are never taken; null and repeated doc_ids are rows of their own, each with its own
share (equal rows differ by their turn only); a text of any length is counted whole; an empty table gives an empty result; columns
besides doc_id, text and source are ignored by ``mix`` and kept by ``stage``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2
#: Parts that documents of one source and size are dealt into, so that a group of copies isn't ranked in one task.
SALTS = 64
#: Parts of a copy that running sums count in.
UNIT = 1 << 20
MAX_ITERATIONS = 60
TOLERANCE = 1e-4


def word_count(text: str):
    """Words `[^ \\t-\\r]+`: places where a word begins."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) by water-filling. Works on one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    s = s.select("source", "source_size", w.cast("long").alias("w"), (F.col("source_size") * CAP).alias("most"))
    # Sources reach their limit in the order of limit / weight; the level L solves sum(min(most, w * L)) = total.
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(every) * SHARE_PERCENT / 100.0, "full": F.coalesce(F.sum("most").over(before), F.lit(0)), "open": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # The first source that its own level doesn't fill decides; with none, all are full.
    s = s.withColumn("final", F.min(F.when(F.col("level") * F.col("w") < F.col("most"), F.struct("full", "level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("w") * F.col("final.level"))).alias("target"))


def balance(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, lam): Newton iterations on the dual. groups: (source, size, n). A null lam stands for infinity (rate 2)."""
    spark = groups.sparkSession
    spread = groups.where("size > 0").groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.sum("n").alias("k"))
    state = targets.join(spread, targets.source.eqNullSafe(spread.source)).select(targets.source, "target", (F.col("s") / F.col("k")).alias("mean"), F.when(F.col("target") < CAP * F.col("source_size"), F.lit(0.0)).alias("lam"), F.lit(False).alias("done"))
    state = stored(state, "mix-state")
    for _ in range(MAX_ITERATIONS):
        live = state.where("lam is not null and not done")
        x = F.col("size") / F.col("mean")
        p = 1 / (1 + F.exp(-F.col("lam") * x))
        g = groups.join(live.withColumnRenamed("source", "src"), groups.source.eqNullSafe(F.col("src"))).where("size > 0")
        step = g.groupBy("src").agg(F.sum(F.col("n") * CAP * p * F.col("size")).alias("got"), F.sum(F.col("n") * CAP * p * (1 - p) * x * F.col("size")).alias("slope"))
        off = F.col("target") - F.col("got")
        near = F.abs(off) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        new = F.when(near | (F.col("slope") <= 0), F.col("lam")).otherwise(F.col("lam") + off / F.col("slope"))
        state = stored(
            state.join(step, state.source.eqNullSafe(step.src), "left").select(state.source, "target", "mean", F.when(F.col("src").isNull(), F.col("lam")).otherwise(new).alias("lam"), F.when(F.col("src").isNull(), F.col("done")).otherwise(near | (F.col("slope") <= 0)).alias("done")),
            "mix-state",
        )
        if state.where("lam is not null and not done").isEmpty():
            break
    return state.select("source", "mean", "lam")


def before(rows: DataFrame, value: str, name: str, down: bool = False) -> DataFrame:
    """rows (source, size, salt, value) with ``name``: the sum of value over those of the source that come before by size and salt."""
    order = F.desc if down else F.asc
    upto = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Ranges of sizes, 64 for each power of two: some hundreds a source.
    shift = F.greatest(F.length(F.bin("size")) - 7, F.lit(0))
    rows = rows.withColumn("range", (shift * 64 + F.floor(F.col("size") / F.pow(F.lit(2.0), shift))).cast("int"))
    tops = rows.groupBy("source", "range").agg(F.sum(value).alias(value)).withColumn("top", upto(Window.partitionBy("source").orderBy(order("range")))).select(F.col("source").alias("_s"), F.col("range").alias("_r"), "top")
    within = rows.withColumn("within", upto(Window.partitionBy("source", "range").orderBy(order("size"), "salt")))
    return within.join(tops, within.source.eqNullSafe(F.col("_s")) & (within["range"] == F.col("_r"))).withColumn(name, F.col("top") + F.col("within")).drop("range", "top", "within", "_s", "_r")


def shares(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """A row per row of docs: the columns ``keep``, and source, size, source_size, target, rate, copies (whole) and taken."""
    row = F.xxhash64("doc_id", "text")
    sized = docs.select(F.col("doc_id").cast("long").alias("id"), row.alias("row"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), *[c.alias(k) for k, c in keep.items()])
    slim = stored(sized.select("source", "size", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-sizes")
    groups = stored(slim.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-groups")
    targets = stored(source_targets(groups.select("source", (F.col("size") * F.col("n")).alias("size"))), "mix-targets")
    lam = balance(groups, targets)
    known = targets.join(lam.withColumnRenamed("source", "src"), targets.source.eqNullSafe(F.col("src")), "left").drop("src")
    rate = F.when(F.col("target") >= CAP * F.col("source_size"), F.lit(float(CAP))).otherwise(CAP / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean"))))
    # Parts of (source, size): at most SALTS per length that occurs, however many documents there are.
    parts = slim.join(known.withColumnRenamed("source", "src"), slim.source.eqNullSafe(F.col("src"))).drop("src")
    parts = parts.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0))).withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
    parts = before(parts.withColumn("all_units", F.col("n") * F.col("units")), "all_units", "start")
    upto = lambda k: F.expr(f"(start + ({k}) * units + {UNIT // 2}L) div {UNIT}L")
    parts = stored(parts.withColumn("copies_all", upto("n") - upto("0")), "mix-parts")
    short = parts.groupBy("source").agg((F.round(F.max("target")).cast("long") - F.sum(F.col("copies_all") * F.col("size"))).alias("short")).withColumnRenamed("source", "src")
    parts = parts.join(short, parts.source.eqNullSafe(F.col("src"))).drop("src")
    # What whole copies leave over or take too much: from the longest documents on, as far as each has room.
    room = F.when(F.col("short") > 0, CAP * F.col("n") - F.col("copies_all")).otherwise(F.col("copies_all")) * F.col("size")
    parts = before(parts.withColumn("room", room), "room", "room_before", down=True)
    parts = parts.withColumn("fix", F.greatest(F.least(F.abs("short") - F.col("room_before"), F.col("room")), F.lit(0)).cast("long"))
    # Rows are dealt by the columns of one key without nulls for both the window and the join, so they are shuffled once.
    named = {"of_source": F.coalesce("source", F.lit("")), "of_none": F.col("source").isNull()}
    key = [*named, "size", "salt"]
    p = stored(parts.withColumns(named).select(*key, "source_size", "target", "rate", "units", "start", "short", "fix"), "mix-parts")
    sized = sized.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).withColumns(named)
    rank = Window.partitionBy(*key).orderBy("id", "row")
    out = sized.withColumn("k", F.row_number().over(rank)).join(p, key)
    out = out.withColumn("copies", upto("k") - upto("k - 1"))
    mine = F.when(F.col("short") > 0, CAP - F.col("copies")).otherwise(F.col("copies")) * F.col("size")
    out = out.withColumn("mine", mine).withColumn("mine_before", F.coalesce(F.sum("mine").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = F.greatest(F.least(F.col("fix") - F.col("mine_before"), F.col("mine")), F.lit(0))
    taken = F.col("copies") * F.col("size") + F.when(F.col("short") > 0, part).otherwise(-part)
    return out.select(*keep, "source", "size", "source_size", "target", "rate", "copies", taken.cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies (whole) and taken: a row per row of docs."""
    return shares(docs, {"doc_id": F.col("doc_id")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole; one taken for part of a copy has its words cut to that part. n_chars follows the text.

    Rows with null or repeated doc_ids have shares of their own; null and empty texts are never taken; columns keep their names.
    """
    m = shares(docs, {"doc": F.struct(*docs.columns)}).where("taken > 0")
    rest = F.col("taken") % F.col("size")
    whole = F.array_repeat(F.lit(None).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    m = m.select("doc", F.explode(F.concat(whole, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))).alias("cut"))
    # The first `cut` words with the white space before each.
    head = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), 1, F.col("cut").cast("int")), "")
    m = m.withColumn("new", F.when(F.col("cut").isNull(), F.col("doc.text")).otherwise(head))
    kinds = dict(docs.dtypes)
    changed = {"text": F.col("new"), "n_chars": F.length("new").cast(kinds.get("n_chars", "long"))}
    return m.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
