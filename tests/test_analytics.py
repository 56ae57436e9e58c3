"""Medians, bootstraps, coincidences, comparisons and ladders beside plain Python, hot groups and odd rows included."""

import dataclasses
import itertools
import random
import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.operators import eventlog, infer, measure, quality
from tactus.operators import streams as S
from tactus.plans import registry

SF = "/root/testdata/sf0.001"


def test_no_aggregate_holds_a_group(spark):
    for name in ("budget_report", "profile_pivot", "event_gaps", "phase_profile", "phase_excess", "bootstrap_point", "bootstrap_ratio", "coincidence"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and "collect_list" not in plan, name


def test_medians_equal_sorting(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "b", None]), r.choice([0, 1]), r.choice([None, r.randint(-5, 5), r.randint(-(10**9), 10**9)])) for _ in range(500)] + [("only null", 0, None)]
    df = spark.createDataFrame(data, "case string, profile int, x long")
    want = {}
    for c, p, x in data:
        if x is not None:
            want.setdefault((c, p), []).append(x)
    got = {(m["case"], m["profile"]): m["median"] for m in measure.medians(df, ["case", "profile"], "x").collect()}
    assert got == {k: float(statistics.median(v)) for k, v in want.items()}
    wide = {w["case"]: (w["0"], w["1"]) for w in measure.profile_pivot(df, "case", "profile", "x", ["0", "1"]).collect()}
    assert wide == {c: (got.get((c, 0)), got.get((c, 1))) for c in {c for c, _, _ in data}}
    phases = df.withColumn("iter", F.monotonically_increasing_id())
    rows = [tuple(x) for x in phases.select("iter", "x").collect()]
    of = lambda keep: [x for i, x in rows if x is not None and keep(i)]
    e = eventlog.phase_excess(phases, 7, "x").first()
    assert (e.edge_median, e.median) == (statistics.median(of(lambda i: i % 7 == 6)), statistics.median(of(lambda i: True)))
    for p in eventlog.phase_profile(phases, 7, "x").collect():
        assert p.n == sum(i % 7 == p.phase for i, _ in rows) and p.median == statistics.median(of(lambda i, p=p: i % 7 == p.phase))


# --- bootstrap ---
@pytest.mark.parametrize("ties", [False, True])
def test_large_cells_give_the_same_replicates(spark, ties):
    rng = np.random.default_rng(9)
    cells = {("big", "F"): rng.integers(0, 20 if ties else 10**6, 3_000), ("big", "O"): rng.integers(5, 30 if ties else 10**6, 40), ("small", "F"): rng.integers(1, 9, 7), ("small", "O"): rng.integers(1, 9, 2_001), (None, "F"): rng.integers(1, 99, 500), (None, "O"): rng.integers(1, 99, 501)}
    df = spark.createDataFrame([(c, p, int(x)) for (c, p), xs in cells.items() for x in xs], "cell string, p string, x long")
    got = {r.cell: r for r in infer.bootstrap_ratio(df, "cell", "p", "x", "F", "O", replicates=60).collect()}
    assert set(got) == {"big", "small", None}
    for c, r in got.items():
        x, y = (infer.resampled_medians(np.sort(cells[c, p]).astype(float), 60, infer._seeded(1, c, i)) for i, p in enumerate("FO"))
        assert (r.ratio, r.lo, r.hi) == (np.median(cells[c, "F"]) / np.median(cells[c, "O"]), *infer.bounds(np.sort(x[y != 0] / y[y != 0])))


def test_cells_that_lack_values(spark):
    rows = [("no top", "O", 3), ("no bottom", "F", 3), ("zero", "F", 3), ("zero", "O", 0), ("null", "F", None), ("null", "O", 5), ("other", "X", 1)]
    got = infer.bootstrap_ratio(spark.createDataFrame(rows, "cell string, p string, x long"), "cell", "p", "x", "F", "O", replicates=10).collect()
    assert sorted(map(tuple, got)) == [("no top", None, None, None), ("null", None, None, None)]


# --- coincidence ---
@pytest.mark.parametrize("seed", range(4))
def test_coincidence_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    spread, tolerance = r.choice([(50, 7), (4, 5), (1_000, 10), (300, 1)])
    a = [(i, None if r.random() < 0.05 else r.randint(-spread, spread)) for i in range(120)] + [(7, 3), (7, 3)]
    b = [(i, None if r.random() < 0.05 else r.randint(-spread, spread)) for i in range(r.choice([3, 60]))]
    want = sorted((i, t) for i, t in a if t is not None and any(u is not None and abs(t - u) <= tolerance for _, u in b))
    A, B = (spark.createDataFrame(x, "id long, t long") for x in (a, b))  # noqa: N806
    assert sorted(map(tuple, eventlog.coincidence(A, B, "t", tolerance).collect())) == want


def test_a_hot_slot_isn_t_paired(spark):
    """A slot with a third of all events on both sides comes down to one row before the join."""
    a = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 5, id) as t")
    j = eventlog.coincidence(a, a, "t", 10)
    assert j.count() == 30_000
    assert "distinct" not in j._jdf.queryExecution().optimizedPlan().toString().lower()


# --- comparison of records ---
def wide(spark, end=30, width=3, delta="1/10"):
    return S.Stream(spark.range(end).select(F.col("id").alias("n"), *[F.expr(f"id * 10 + {i}").alias(f"f{i}") for i in range(width)]), Fraction(delta), width, 0, end)


def compared(a, b, *span):
    return tuple(quality.record_compare(a, b, *span).first())


def test_first_difference_is_found_by_index_and_position(spark):
    a = wide(spark)
    change = lambda e: dataclasses.replace(a, df=a.df.selectExpr("n", *[f"{e.get(f, f)} as {f}" for f in a.fields]))
    without = lambda x, where: dataclasses.replace(x, df=x.df.where(where))
    assert compared(a, a) == (30, 0, 0, True, None, None, None, None)
    b = change({"f1": "if(n = 9, f1 + 1, f1)", "f2": "if(n in (9, 5), null, f2)"})
    assert compared(a, b) == (30, 2, 0, False, 5, 2, "52", None) and compared(a, b, 6, 20) == (20, 1, 0, False, 9, 1, "91", "92")
    assert compared(a, b, 10, 20) == (20, 0, 0, True, None, None, None, None)
    # A record that one side lacks, that both lack, or at the end of the range: a failure.
    assert compared(a, without(a, "n <> 4")) == (29, 0, 1, False, 4, None, None, None)
    assert compared(without(a, "n <> 4"), without(a, "n <> 4")) == (29, 0, 1, False, 4, None, None, None)
    assert compared(without(a, "n <> 8"), without(b, "n <> 8")) == (29, 2, 1, False, 5, 2, "52", None)
    assert compared(without(a, "n not in (2, 8)"), without(b, "n not in (2, 8)")) == (28, 2, 2, False, 2, None, None, None)
    assert compared(a, a, 20, 15) == (10, 0, 5, False, 30, None, None, None)
    assert compared(without(a, "false"), without(a, "false")) == (0, 0, 30, False, 0, None, None, None)
    assert compared(a, a, 0, 0)[:4] == (0, 0, 0, False)  # nothing compared is no success
    # Records of other widths differ where the shorter one ends; the range begins at the greater tail.
    assert compared(a, a.select(F.col("f0"), F.col("f1"))) == (30, 30, 0, False, 0, 2, "2", None)
    assert compared(dataclasses.replace(a, tail=7), dataclasses.replace(a, tail=3))[:4] == (23, 0, 0, True)


def test_holes_are_found_in_any_bucket(spark):
    for gone in ([], [0], [99], [37, 81], list(range(20, 60)), list(range(100))):
        rows = spark.createDataFrame([(n,) for n in range(100) if n not in gone], "n long")
        assert [r.hole for r in quality.first_hole(rows, 0, 100, bucket=10).collect()] == [min(gone, default=None)]


# --- ladders ---
def test_ladder_and_its_ledger(spark):
    r = random.Random(4)
    rows = []
    for family, (case, scale) in itertools.product("abcdef", itertools.product("xyz", (1, 2, 4, 8))):
        slot = 1000.0 / scale
        worst = {"a": 100, "b": 300, "c": {"x": 100, "y": 600, "z": 200}[case], "d": 900, "e": None if case == "x" else 50, "f": r.randint(50, 700)}[family]
        rows += [(family, case, scale, worst, slot), (family, case, scale, None if worst is None else worst - 10, slot)]
    df = spark.createDataFrame(rows, "family string, task string, scale int, p99 long, slot double")
    rates, ledger = measure.ladder_ledger(df, "family", "task", "scale", "p99", "slot")
    fits = {(f, c, s): w is not None and w <= 0.5 * slot for f, c, s, w, slot in rows[::2]}
    worst = {(f, c): w for f, c, s, w, _ in rows[::2] if s == 1}
    want, gone = {}, []
    for f in "abcdef":
        whole = [s for s in (1, 2, 4, 8) if all(fits[f, c, s] for c in "xyz")]
        left = "xyz" if whole else [c for c in "xyz" if fits[f, c, 1]]
        scales = [s for s in (1, 2, 4, 8) if left and all(fits[f, c, s] for c in left)]
        want[f] = (max(scales, default=None), len(left), 3 - len(left))
        gone += [(f, c, 1, worst[f, c], 500.0, 1e6, None if worst[f, c] is None else 5e8 / worst[f, c]) for c in "xyz" if c not in left]
    assert {x.family: (x.scale, x.cases, x.excluded) for x in rates.collect()} == want and want["d"] == (None, 0, 3)
    assert sorted(map(tuple, ledger.collect())) == sorted(gone)


def test_run_report_covers_three_metrics(spark):
    r = np.random.default_rng(6)
    data = {k: r.integers(-50, 10_000, (n, 3)).tolist() for k, n in (("a", 400), ("b", 21), ("c", 1))}
    df = spark.createDataFrame([(k, i, *map(int, v)) for k, vs in data.items() for i, v in enumerate(vs)], "run string, iter long, c long, w long, e long")
    for q in measure.run_report(df, "run", {"compute": "c", "wake": "w", "e2e": "e"}, "iter").collect():
        c, w, e = (sorted(x) for x in zip(*data[q.run][int(len(data[q.run]) * 0.05) :], strict=True))
        at = lambda v, k: v[round(k * (len(v) - 1) / 1000)]
        assert (q.slots, q.compute_median, q.compute_p990, q.compute_max, q.compute_sum, q.wake_p999) == (len(c), int(statistics.median(c)), at(c, 990), c[-1], sum(c), at(w, 999))
        assert (q.e2e_p500, q.e2e_p990, q.e2e_p999, q.e2e_max) == (at(e, 500), at(e, 990), at(e, 999), e[-1])


# --- shared plans ---
def test_sums_in_either_order_are_computed_once(spark):
    """a + b and b + a, with all that follows, are one exchange in the plan that has run."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for delta in ("1/10", "1/5"):
            a, b = registry.ev(spark, SF), registry.od(spark, SF, delta)
            of = lambda x, y: S.window_reduce(S.add(x, y).select(F.col("f0") + F.col("f1")), 1, 30, "avg").df
            both = of(a, b).join(of(b, a).withColumnRenamed("f0", "g0"), "n")
            assert both.where("f0 <> g0").count() == 0 and len(both.collect()) > 500
            final = both._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
            assert final.count("ReusedExchange") == 1 and final.count("FileScan") == 2
        x = S.add(a, b).select(F.col("f0") - F.col("f1")).df.withColumnRenamed("f0", "d").join(S.add(b, a).select(F.col("f1") - F.col("f0")).df, "n")
        assert x.where("d <> f0").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
