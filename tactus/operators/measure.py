"""Measurement statistics over tables with one row per sample or per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, run: str, metric: str) -> DataFrame:
    """(run, metric, n, before, size): each value that is there, its rows, the run's rows with less, and all of the run's.

    Counts by value come first; they are summed up over ranges of values, and within each, so that no task sorts a run. NULL
    values are left out.
    """
    counts = df.where(F.col(metric).isNotNull()).groupBy(run, metric).agg(F.count("*").alias("n"))
    x = F.col(metric).cast("double")
    # Sixteen ranges for each power of two, in the order of the values.
    counts = counts.withColumn("range", F.when(x == 0, 0).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x)) * 16) + 20_000)).cast("int"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_run = Window.partitionBy("run_")
    tops = counts.groupBy(F.col(run).alias("run_"), F.col("range").alias("range_")).agg(F.sum("n").alias("n")).select("run_", "range_", upto(by_run.orderBy("range_")).alias("top"), F.sum("n").over(by_run).alias("size"))
    within = counts.withColumn("within", upto(Window.partitionBy(run, "range").orderBy(metric)))
    both = within.join(tops, within[run].eqNullSafe(F.col("run_")) & (within["range"] == F.col("range_")))
    return both.select(run, metric, "n", (F.col("top") + F.col("within")).alias("before"), "size")


def at_rank(metric: str, rank: Column) -> Column:
    """Aggregate over ``placed``: the value at a rank from 0 on."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(metric)))


def warmup_trim(df: DataFrame, run: str, order: str, percent: int = 5) -> DataFrame:
    """Without the first ``percent`` of each run's rows; of rows with equal order any may stay. Rows without order come first."""
    first = df.withColumn(order, F.coalesce(F.col(order), F.lit(-(2**62)).cast(df.schema[order].dataType))) if df.schema[order].nullable else df
    drop = F.expr(f"(size * {percent}) div 100")
    cut = placed(first, run, order).where((F.col("before") <= drop) & (drop < F.col("before") + F.col("n"))).select(F.col(run).alias("run_"), F.col(order).alias("cut_"), (drop - F.col("before")).alias("drop_"))
    rows = df.join(cut, df[run].eqNullSafe(F.col("run_")))
    at = F.coalesce(F.col(order), F.lit(-(2**62)).cast(df.schema[order].dataType))
    tied = rows.where(at == F.col("cut_")).withColumn("rn_", F.row_number().over(Window.partitionBy(run).orderBy(order))).where("rn_ > drop_")
    return rows.where(at > F.col("cut_")).select(*df.columns).unionByName(tied.select(*df.columns))


def percentile_nearest(df: DataFrame, run: str, metric: str, per_mille: list[int]) -> DataFrame:
    """(run, p<k>): the value at round(k / 1000 * (N - 1)), halves to even."""
    at = lambda k: F.expr(f"cast(bround({k} * (size - 1) / 1000D) as long)")
    return placed(df, run, metric).groupBy(run).agg(*[at_rank(metric, at(k)).alias(f"p{k}") for k in per_mille])


def percentile_floor(df: DataFrame, run: str, metric: str, per_cent: list[int]) -> DataFrame:
    """(run, p<k>): the value at min(N - 1, floor(k / 100 * N))."""
    at = lambda k: F.expr(f"least(size - 1, (size * {k}) div 100)")
    return placed(df, run, metric).groupBy(run).agg(*[at_rank(metric, at(k)).alias(f"p{k}") for k in per_cent])


def medians(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, median) of each group with a value, from counted values: no task holds a group."""
    p = placed(df.select(F.struct(*keys).alias("group_"), F.col(metric).alias("value_")), "group_", "value_")
    return p.groupBy("group_").agg(middle("value_").alias("median")).select(*[F.col(f"group_.{k}").alias(k) for k in keys], "median")


def middle(metric: str) -> Column:
    """Aggregate over ``placed``: the median."""
    return ((at_rank(metric, F.expr("(size - 1) div 2")) + at_rank(metric, F.expr("size div 2"))) / 2).cast("double")


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which any may be NULL."""
    other = right.withColumnsRenamed({k: f"{k}_of" for k in keys})
    same = [left[k].eqNullSafe(F.col(f"{k}_of")) for k in keys]
    return left.join(other, same, "left").drop(*[f"{k}_of" for k in keys])


def run_summary(df: DataFrame, run: str, metric: str) -> DataFrame:
    at = lambda k: F.expr(f"cast(bround({k} * (size - 1) / 1000D) as long)")
    kind = df.schema[metric].dataType.simpleString()
    total = F.sum(F.col(metric) * F.col("n")) if kind in ("double", "float") else F.sum(F.col(metric).cast("long") * F.col("n"))
    return placed(df, run, metric).groupBy(run).agg(F.sum("n").alias("slots"), middle(metric).alias("median"), F.max(metric).alias("largest"), total.alias("total"), *[at_rank(metric, at(k)).alias(f"p{k}") for k in (990, 999)])


#: What a run's report takes of each metric.
REPORTED = {"compute": ("median", "p990", "max", "sum"), "wake": ("p999",), "e2e": ("p500", "p990", "p999", "max")}


def run_report(df: DataFrame, run: str, metrics: dict[str, str], order: str | None = None, percent: int = 5) -> DataFrame:
    """(run, slots, <metric>_<statistic> ...) of three integer metrics, by role: {compute, wake, e2e: column}; with ``order``, without the warm-up.

    The metrics are stacked, so all are placed by one pass over the runs. Medians are truncated to integers.
    """
    x = warmup_trim(df, run, order, percent) if order else df
    stacked = x.select(F.col(run).alias("run_"), F.inline(F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).cast("long").alias("value_")) for role, c in metrics.items()])))
    p = placed(stacked.select(F.struct("run_", "role").alias("group_"), "value_"), "group_", "value_")
    p = p.select("group_.run_", "group_.role", "value_", "n", "before", "size")

    def statistic(name: str) -> Column:
        if name[0] == "p":
            return at_rank("value_", F.expr(f"cast(bround({name[1:]} * (size - 1) / 1000D) as long)"))
        return {"median": middle("value_").cast("long"), "max": F.max("value_"), "sum": F.sum(F.col("value_") * F.col("n"))}[name]

    names = sorted({s for of in REPORTED.values() for s in of})
    each = p.groupBy("run_", "role").agg(F.max("size").alias("slots"), *[statistic(s).alias(s) for s in names])
    cols = [F.max(F.when(F.col("role") == role, F.col(s))).alias(f"{role}_{s}") for role in metrics for s in REPORTED[role]]
    return each.groupBy("run_").agg(F.max("slots").alias("slots"), *cols).withColumnRenamed("run_", run)


def budget_report(df: DataFrame, run: str, metric: str, budget: int) -> DataFrame:
    s = joined(df.groupBy(run).agg(F.max(metric).alias("largest"), F.avg(metric).alias("mean")), medians(df, [run], metric), [run])
    return s.select(run, F.round(100 * F.col("largest") / budget, 6).alias("max_percent"), (F.col("largest") <= budget).alias("fits"), F.round(1e9 / F.col("mean"), 3).alias("per_s_mean"), F.round(1e9 / F.col("median"), 3).alias("per_s_median"))


def overrun_share(df: DataFrame, run: str, metric: str, slot: int) -> DataFrame:
    return df.groupBy(run).agg((F.count_if(F.col(metric) > slot) / F.count("*")).alias("share"))


def rate_ceiling(df: DataFrame, family: str, rate: str, fits: Column) -> DataFrame:
    """(family, ceiling): the highest rate at which every slot fits."""
    return df.groupBy(family, rate).agg(F.bool_and(fits).alias("ok")).groupBy(family).agg(F.max(F.when(F.col("ok"), F.col(rate))).alias("ceiling"))


def ladder_select(df: DataFrame, family: str, case: str, scale: str, fits: Column) -> DataFrame:
    """(family, scale, cases): the largest scale at which every case fits that fits at the lowest one."""
    ok = df.groupBy(family, case, scale).agg(F.bool_and(fits).alias("ok"))
    low = ok.groupBy(family).agg(F.min(scale).alias("low"))
    out = ok.join(low, family).where((F.col(scale) == F.col("low")) & ~F.col("ok")).select(family, case)
    per = ok.join(out, [family, case], "left_anti").groupBy(family, scale).agg(F.bool_and("ok").alias("ok"), F.count("*").alias("cases"))
    return per.where("ok").groupBy(family).agg(F.max(F.struct(scale, "cases")).alias("best")).select(family, F.col(f"best.{scale}").alias(scale), "best.cases")


def ladder_ledger(df: DataFrame, family: str, case: str, scale: str, worst: str, slot: str, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((family, scale, cases, excluded), (family, case, scale, p99, budget, stream_hz, required_hz)): the ladder with its ledger.

    df: rows with a p99 (``worst``) and a slot in ns for each case and scale. A case fits where its worst p99 is within ``share`` of the
    slot. Where no scale fits all cases of a family, those that don't fit at the lowest scale are excluded, with the frequency of
    slots that they would need, and the others choose; a family without any left has a NULL scale.
    """
    cell = df.groupBy(family, case, scale).agg(F.max(worst).alias("p99"), F.min(slot).alias("slot_"))
    cell = cell.withColumn("fits", F.coalesce(F.col("p99") <= share * F.col("slot_"), F.lit(False)))
    # A family whose cases all fit at some scale excludes none, even where one misses the lowest.
    every = cell.groupBy(family).agg(F.count_distinct(case).alias("every"), F.min(scale).alias("low_"))
    rung = cell.groupBy(family, scale).agg(F.bool_and("fits").alias("all_fit"), F.count("*").alias("here"))
    whole = rung.join(every, family).where(F.col("all_fit") & (F.col("here") == F.col("every"))).groupBy(family).agg(F.max(scale).alias("scale_"))
    open_ = every.join(whole, family, "left").withColumnRenamed("scale_", "resolved")
    at = cell.join(open_, family)
    out = at.where(F.col("resolved").isNull() & (F.col(scale) == F.col("low_")) & ~F.col("fits"))
    ledger = out.select(family, case, scale, "p99", (share * F.col("slot_")).alias("budget"), (1e9 / F.col("slot_")).alias("stream_hz"), (share * 1e9 / F.col("p99")).alias("required_hz"))
    lost = out.groupBy(family).agg(F.count("*").alias("excluded"))
    left = at.join(out.select(family, case), [family, case], "left_anti")
    held = left.groupBy(family).agg(F.count_distinct(case).alias("cases"))
    best = left.groupBy(family, scale).agg(F.bool_and("fits").alias("ok"), F.count("*").alias("here")).join(held, family).where(F.col("ok") & (F.col("here") == F.col("cases"))).groupBy(family).agg(F.max(scale).alias("best"))
    rates = open_.join(held, family, "left").join(lost, family, "left").join(best, family, "left")
    return rates.select(family, F.coalesce("resolved", "best").alias(scale), F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("excluded", F.lit(0)).alias("excluded")), ledger


def budget_violations(df: DataFrame, case: str, profile: str, p99: str, budgets: DataFrame) -> DataFrame:
    """Cells whose worst p99 is over half the case's slot."""
    return df.groupBy(case, profile).agg(F.max(p99).alias("worst")).join(budgets, case).where(2 * F.col("worst") > F.col("slot")).select(case, profile, "worst", "slot")


def profile_pivot(df: DataFrame, case: str, profile: str, metric: str, profiles: list[str]) -> DataFrame:
    """(case, a column per profile): medians."""
    m = medians(df.where(F.col(profile).isin(profiles)), [case, profile], metric)
    wide = m.groupBy(case).agg(*[F.max(F.when(F.col(profile) == p, F.col("median"))).alias(p) for p in profiles])
    return joined(df.select(case).distinct(), wide, [case])


def iqr_exclusive(df: DataFrame, run: str, metric: str) -> DataFrame:
    """(run, q1, q3, iqr) by interpolation at (N + 1) * q."""

    def at(k: int) -> Column:
        lo, frac = F.expr(f"((size + 1) * {k}) div 4"), F.expr(f"((size + 1) * {k}) % 4 / 4D")
        v = lambda i: at_rank(metric, F.greatest(F.least(i, F.col("size")), F.lit(1)) - 1)
        return v(lo) + (v(lo + 1) - v(lo)) * F.max(frac)

    return placed(df, run, metric).groupBy(run).agg(at(1).alias("q1"), at(3).alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))


def relative_change(old: DataFrame, new: DataFrame, key: str, metric: str) -> DataFrame:
    j = old.select(key, F.col(metric).alias("old")).join(new.select(key, F.col(metric).alias("new")), key)
    return j.withColumn("change", F.round((F.col("new") - F.col("old")) / F.col("old"), 9))


def class_verdict(df: DataFrame, kind: str, gap: str, witness: str) -> DataFrame:
    """(kind, gap, n, regime, witnesses): how form and oracle differ, with the two least witnesses of each direction."""
    of = df.groupBy(kind, gap, witness).agg(F.count("*").alias("rows_"))
    least = F.min(F.when(F.col(witness).isNotNull(), F.struct(F.col(witness).alias("w"), F.col("rows_").alias("k"))))
    one = of.groupBy(kind, gap).agg(F.sum("rows_").alias("n"), least.alias("one_"))
    # The second is another row of the first's value, or the least value above it.
    up = of.join(one.select(F.col(kind).alias("k_"), F.col(gap).alias("g_"), F.col("one_.w").alias("w_")), of[kind].eqNullSafe(F.col("k_")) & of[gap].eqNullSafe(F.col("g_")) & (of[witness] > F.col("w_")))
    two = up.groupBy("k_", "g_").agg(F.min(witness).alias("next_"))
    regime = F.when(F.col(gap) == 0, "exact").when(F.col(gap) > 0, "over").otherwise("under")
    out = one.join(two, one[kind].eqNullSafe(F.col("k_")) & one[gap].eqNullSafe(F.col("g_")), "left")
    return out.select(kind, gap, "n", F.col("one_.w").alias("first"), F.when(F.col("one_.k") > 1, F.col("one_.w")).otherwise(F.col("next_")).alias("second"), regime.alias("regime"))


def divergence_share(df: DataFrame, group: str, diverges: Column) -> DataFrame:
    return df.agg(F.count_distinct(group).alias("groups"), F.count_distinct(F.when(diverges, F.col(group))).alias("diverging")).withColumn("share", F.col("diverging") / F.col("groups"))


def win_table(df: DataFrame, family: str, task: str, model: str, metric: str, a: str, b: str) -> DataFrame:
    """(family, tasks, wins): tasks in which model a's total is less than model b's, and the share."""
    p = df.groupBy(family, task).agg(F.sum(F.when(F.col(model) == a, F.col(metric))).alias("a"), F.sum(F.when(F.col(model) == b, F.col(metric))).alias("b")).where("a is not null and b is not null")
    return p.groupBy(family).agg(F.count("*").alias("tasks"), F.count_if(F.col("a") < F.col("b")).alias("wins")).withColumn("majority", F.col("wins") * 2 > F.col("tasks"))
