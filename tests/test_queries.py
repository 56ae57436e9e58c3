"""Every query of the library beside its oracle, and the algebra beside brute force."""

import dataclasses
import itertools
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from tactus.functions import expr
from tactus.functions.index import left_position, right_position
from tactus.operators import eventlog, infer, measure, pipelines, quality
from tactus.operators import streams as S
from tactus.plans import registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, con, name):
    said = difference(spark, con, SF, registry.QUERIES[name], registry.ORACLES[name])
    if said == "no rows":  # of the smallest tables; the next size has some
        said = difference(spark, connect(LARGER), LARGER, registry.QUERIES[name], registry.ORACLES[name])
    assert said is None, said


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_interleave_positions_for_all_small_ratios():
    for p in range(1, 9):
        for q in range(1, 9):
            taken = sorted([(left_position(k, p, q), "a", k) for k in range(40)] + [(right_position(j, p, q), "b", j) for j in range(40)])
            z = Fraction(q, p + q)
            for n, side, i in taken[:30]:
                lo, hi = int(z * n), int(z * (n + 1))
                assert (side, i) == (("b", n - lo) if lo == hi else ("a", lo))


def test_worked_answers(spark):
    a = S.from_table(spark.range(200), "id", [__import__("pyspark").sql.functions.expr("id + 1")], "1/10")
    b = S.from_table(spark.range(200), "id", [__import__("pyspark").sql.functions.expr("id + 1001")], "1/5")
    first = [r.f0 for r in S.interleave(a, b).trimmed().orderBy("n").limit(6).collect()]
    assert first == [1001, 1, 2, 1002, 3, 4]
    mix = S.interleave(S.shift(a, 2), S.shift(b, 1))
    assert mix.origin == 3
    w = S.window_reduce(mix, 1, 30, "avg")
    assert w.origin == 32 and w.trimmed().orderBy("n").first().f0 == 342
    x = S.from_table(spark.range(10), "id", [__import__("pyspark").sql.functions.expr("(id * 37) % 1000 - 500")], "1/1000")
    assert [r.f0 for r in S.fir(x, [1, 2, 3]).df.orderBy("n").limit(3).collect()] == [-2852, -2630, -2408]


def test_integer_division(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(expr.idiv(F.lit(-7), 2).alias("a"), expr.idiv(F.lit(7), 0).alias("b"), expr.saturate(F.lit(2**40)).alias("c"), expr.sumc(F.array(F.lit(None).cast("long"))).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (-3, None, 2**31 - 1, None)


def test_windows_have_no_single_partition(spark):
    s = registry.ev(spark, SF)
    plan = S.window_reduce(s, 1, 30, "avg").df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("call", [lambda s: S.shift(s, 0), lambda s: S.decimate(s, "1/20"), lambda s: S.window(s, 0, 3), lambda s: S.left_of(s, s.delta)])
def test_wrong_arguments_raise(spark, call):
    with pytest.raises(ValueError):
        call(registry.ev(spark, SF))


def test_bootstrap_covers_all_cells(spark, con):
    cells = con.sql("SELECT count(*) FROM (SELECT l_returnflag, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_linestatus = 'F') AND bool_or(l_linestatus = 'O'))").fetchall()[0][0]
    rows = registry.QUERIES["bootstrap_ratio"](spark, SF).where("lo <= ratio and ratio <= hi").collect()
    assert infer.REPLICATES == 10_000 and len(rows) == cells


def test_resampled_medians_equal_all_samples():
    for xs in ([5.0], [1.0, 4.0], [1.0, 2.0, 7.0], [1.0, 2.0, 4.0, 9.0], [0.0, 1.0, 3.0, 7.0, 15.0]):
        brute = Counter(float(np.median(s)) for s in itertools.product(xs, repeat=len(xs)))
        got = Counter(infer.resampled_medians(np.array(xs), 200_000, np.random.default_rng(3)).tolist())
        assert set(got) == set(brute) and all(abs(got[m] / 200_000 - k / len(xs) ** len(xs)) < 0.005 for m, k in brute.items())


def test_bootstrap_equals_resampling(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(50, 150, 40).tolist(), rng.integers(80, 120, 31).tolist()
    row = infer.bootstrap_ratio(spark.createDataFrame([("c", "F", x) for x in a] + [("c", "O", x) for x in b], "cell string, p string, x long"), "cell", "p", "x", "F", "O").first()
    brute = sorted(np.median(rng.choice(a, (10_000, 40)), axis=1) / np.median(rng.choice(b, (10_000, 31)), axis=1))
    assert row.ratio == np.median(a) / np.median(b)
    assert abs(row.lo - brute[250]) < 0.03 and abs(row.hi - brute[9749]) < 0.03


def test_interval_bounds_are_floored_ranks():
    assert infer.bounds(np.arange(10_000.0)) == (249.0, 9749.0) and infer.bounds(np.array([5.0])) == (5.0, 5.0)


def test_difference_of_ratios_equals_resampling(spark):
    rng = np.random.default_rng(5)
    groups = {g: rng.integers(lo, lo + 60, n).tolist() for g, lo, n in (("a", 50, 30), ("b", 80, 25), ("c", 60, 21), ("d", 70, 28))}
    rows = [("x", g, v) for g, vs in groups.items() for v in vs] + [("lacks d", g, 5) for g in "abc"]
    got = infer.bootstrap_difference(spark.createDataFrame(rows, "cell string, g string, v long"), "cell", "g", "v", ("a", "b", "c", "d")).collect()
    m = {g: np.median(rng.choice(vs, (10_000, len(vs))), axis=1) for g, vs in groups.items()}
    brute = np.sort(m["a"] / m["b"] - m["c"] / m["d"])
    assert [r.cell for r in got] == ["x"] and abs(got[0].diff - (np.median(groups["a"]) / np.median(groups["b"]) - np.median(groups["c"]) / np.median(groups["d"]))) < 1e-12
    assert abs(got[0].lo - brute[249]) < 0.03 and abs(got[0].hi - brute[9749]) < 0.03
    verdict = infer.equivalence(spark.createDataFrame([(1, 0.0, -0.01, 0.01), (1, 0.5, 0.4, 0.6), (2, 0.0, -0.5, 0.5)], "grp int, diff double, lo double, hi double"), "grp").orderBy("grp").collect()
    assert [(r.cells, r.none, r.any_effect) for r in verdict] == [(2, False, True), (1, False, False)]


def test_classes_follow_the_intervals(spark):
    rows = spark.createDataFrame([(0.8, 0.7, 0.95), (0.8, 0.7, 1.0), (1.2, 1.1, 1.3), (1.2, 1.0, 1.3), (1.0, 0.5, 2.0)], "r double, lo double, hi double")
    assert [r[0] for r in rows.select(infer.classify(F.col("r"), F.col("lo"), F.col("hi"))).collect()] == ["A", "B", "C", "B", "B"]
    x = registry.QUERIES["bootstrap_ratio"](spark, SF).collect()
    got = {r.cell: r["class"] for r in registry.QUERIES["classify_bootstrap"](spark, SF).collect()}
    want = {r.cell: "A" if r.ratio is not None and r.ratio <= 0.9 and r.hi < 1 else "C" if r.ratio is not None and r.ratio >= 1.1 and r.lo > 1 else "B" for r in x}
    assert got == want


def brute_tail(s, needs, records=400):
    """Least wait by definition, over many records."""
    return max(0, *(math.ceil((i + 1 + t) * d / s.delta) - 1 - n for n in range(records) for i, d, t in needs(n)))


def test_tails_equal_their_definition(spark):
    one = lambda d: S.from_table(spark.range(50), "id", [F.col("id")], d)
    for da, db in [("1/10", "1/5"), ("1/10", "147/1000"), ("3/7", "2/9"), ("6/4", "1"), ("1", "1")]:
        a, b = dataclasses.replace(one(da), tail=2), dataclasses.replace(one(db), tail=1)
        mix, both = S.interleave(a, b), S.add(a, b)
        side = lambda n: (1, n - math.floor(n * b.delta / (a.delta + b.delta))) if math.floor(n * b.delta / (a.delta + b.delta)) == math.floor((n + 1) * b.delta / (a.delta + b.delta)) else (0, math.floor(n * b.delta / (a.delta + b.delta)))  # noqa: B023, E731
        assert mix.tail == brute_tail(mix, lambda n: [(side(n)[1], (a, b)[side(n)[0]].delta, (2, 1)[side(n)[0]])])  # noqa: B023
        assert both.tail == brute_tail(both, lambda n: [(math.floor(n * both.delta / s.delta), s.delta, s.tail) for s in (a, b)])  # noqa: B023
        slow = S.decimate(a, a.delta * Fraction(7, 3))
        assert slow.tail == brute_tail(slow, lambda n: [(math.ceil(n * slow.delta / a.delta), a.delta, 2)])  # noqa: B023
        assert S.shift(mix, 3).tail == max(0, mix.tail - 3)
    wide = dataclasses.replace(one("1/10").select(F.col("f0"), F.col("f0"), F.col("f0")), tail=1)
    for step in (1, 2, 5):
        w = S.window_reduce(wide, step, 4, "sumc")
        assert w.tail == S.window(wide, step, 4).tail == brute_tail(w, lambda n: [(n * step // 3, wide.delta, 1)])  # noqa: B023


def test_rescaling_and_unreduced_ratios_change_nothing(spark):
    a, b = registry.ev(spark, SF), registry.od(spark, SF)
    plan = lambda x, y: S.window_reduce(S.interleave(S.shift(x, 2), y), 1, 30, "avg")
    one, scaled = plan(a, b), plan(S.rescale(a, "7/3"), S.rescale(b, "7/3"))
    assert scaled.delta == one.delta * Fraction(7, 3) and (scaled.origin, scaled.end, scaled.tail) == (one.origin, one.end, one.tail)
    assert scaled.trimmed().exceptAll(one.trimmed()).count() == 0
    x, y = (S.interleave(registry.ev(spark, SF, r), registry.od(spark, SF, "1")) for r in ("6/4", "3/2"))
    assert (x.delta, x.origin, x.end, x.tail) == (y.delta, y.origin, y.end, y.tail) and x.trimmed().exceptAll(y.trimmed()).count() == 0
    with pytest.raises(ValueError):
        S.rescale(a, 0)


def test_shared_streams_are_computed_once(spark):
    with S.shared(S.add(registry.ev(spark, SF), registry.od(spark, SF, "1/10"))) as s:
        both = S.add(s.select(F.col("f0") + F.col("f1")), s.select(F.col("f1") + F.col("f0"))).df
        assert both._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") >= 2 and both.where("f0 <> f1").count() == 0
    assert not s.df.is_cached


def test_windows_keep_nulls_and_cross_buckets(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i * i) for i in range(60)], "n long, f0 long")
    s = S.Stream(rows, Fraction(1), 1, 0, 60)
    for step, length in [(1, 4), (3, 7), (5, 5), (7, -3)]:
        got = {r.n: r.f0 for r in S.window(s, step, length, bucket=4).df.collect()}
        size, v = abs(length), lambda i: None if i % 5 == 0 else i * i
        want = {n: [v(n * step - k) for k in range(size)][:: 1 if length > 0 else -1] for n in range(60) if n * step < 60 and n * step >= size - 1}
        assert got == want


@pytest.mark.parametrize("bucket", [300, 1_000])
def test_chain_of_windows_crosses_ranges_and_holes(spark, bucket):
    rows = spark.range(1_500).where("id <> 700").selectExpr("id as n", "if(id = 1200, null, id * 37 % 1000 - 500) as f0", "id as f1")
    s = S.Stream(rows.repartition(7), Fraction(1, 360), 2, 0, 1_500)
    got = {r.n: (r.f0, r.f1, r.mwi, r.thr) for r in pipelines.qrs_chain(s, registry.TAPS25, bucket).collect()}
    x = [None if n in (700, 1200) else n * 37 % 1000 - 500 for n in range(1_500)]
    trunc = lambda a, b: int(math.copysign(abs(a) // b, a)) if a else 0
    fir = lambda v, taps: [sum(c * v[n - k] for k, c in enumerate(taps)) if n >= len(taps) - 1 and None not in v[n - len(taps) + 1 : n + 1] else None for n in range(len(v))]
    avg = lambda v, k: [trunc(sum(v[n - k + 1 : n + 1]), k) if n >= k - 1 and None not in v[n - k + 1 : n + 1] else None for n in range(len(v))]
    bp = [None if y is None else trunc(y, 1000) for y in fir(x, registry.TAPS25)]
    sq = [None if y is None else trunc(y * y, 1000) for y in fir(bp, pipelines.DERIVATIVE)]
    mwi = avg(sq, pipelines.SHORT)
    thr = avg(mwi, pipelines.LONG)
    assert got == {n: (x[n], n, mwi[n], thr[n]) for n in range(1_500) if thr[n] is not None}


def test_resampling_equals_zero_stuffing(spark):
    x = np.random.default_rng(8).normal(size=37)
    s = S.Stream(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "n long, f0 double"), Fraction(1), 1, 0, len(x))
    for up, down, taps in [(2, 1, [0.25, 0.5, 1.0, 0.5, 0.25]), (1, 2, [0.2, 0.6, 0.2]), (3, 2, list(np.linspace(-1, 1, 11))), (2, 3, [1.0]), (5, 7, list(np.linspace(0, 1, 21)))]:
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        full = np.convolve(stuffed, taps)[len(taps) // 2 :][: len(stuffed)]
        got = S.resample(s, up, down, taps, bucket=5)
        y = {r.n: r.f0 for r in got.df.collect()}
        assert got.end == len(y) == len(full[::down]) and np.allclose([y[n] for n in range(got.end)], full[::down])


def test_rational_numbers(spark):
    pairs = [(6, 4), (-6, 4), (6, -4), (0, 5), (7, 7), (2**40, 2**20 * 3), (5, 0)]
    rows = spark.createDataFrame(pairs, "a long, b long").select(expr.rational(F.col("a"), F.col("b")).alias("r")).collect()
    want = [(Fraction(a, b).numerator, Fraction(a, b).denominator) if b else None for a, b in pairs]
    assert [r.r and tuple(r.r) for r in rows] == want


def test_percentiles_equal_sorting(spark):
    r = np.random.default_rng(12)
    data = {"a": [float(x) for x in r.normal(size=101)], "b": [0.0, 0.0, -3.5, 2.25, 1e9, -1e-9, 2.25], "c": [4.0], None: [1.0, 2.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "run string, iter long, x double")
    got = {q.run: q for q in measure.percentile_nearest(df, "run", "x", [0, 500, 990, 1000]).collect()}
    for k, vs in data.items():
        assert [got[k][f"p{q}"] for q in (0, 500, 990, 1000)] == [sorted(vs)[round(q * (len(vs) - 1) / 1000)] for q in (0, 500, 990, 1000)]
    s = {q.run: q for q in measure.run_summary(df, "run", "x").collect()}
    assert all(s[k].slots == len(vs) and s[k].median == float(np.median(vs)) and s[k].largest == max(vs) for k, vs in data.items())
    trimmed = measure.warmup_trim(df, "run", "iter", 20).collect()
    assert sorted((str(q.run), q.iter) for q in trimmed) == sorted((str(k), i) for k, vs in data.items() for i in range(len(vs) * 20 // 100, len(vs)))


def test_gaps_and_runs_cross_buckets(spark):
    at = sorted(np.random.default_rng(13).choice(5_000, 400, replace=False).tolist())
    df = spark.createDataFrame([("r", int(x)) for x in at], "role string, t long")
    g = eventlog.event_gaps(df, "role", "t", bucket=50).first()
    gaps = np.diff(at)
    assert (g.least, g.median, g.largest) == (gaps.min(), float(np.median(gaps)), gaps.max())
    hits = {n for n in range(3_000) if n % 37 < 20 or 500 <= n < 1_400}
    got = {(r.first, r.length) for r in quality.runs(spark.range(3_000).withColumnRenamed("id", "n"), F.col("n").isin(sorted(hits)), bucket=10, fan=5).collect()}
    assert got == {(n, next(k for k in itertools.count(1) if n + k not in hits)) for n in hits if n - 1 not in hits}


def test_consistency_of_nothing_is_an_error(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7)], "k long, v long")
    check = lambda d: tuple(quality.consistency(d, ["k"], ["v"]).first())
    assert check(df) == (2, 1, False) and check(df.where("k = 1")) == (1, 0, True) and check(df.where("false")) == (0, 0, False)


def test_spans_grow_with_the_tables(spark):
    parts, events = (registry.table(spark, SF, t).count() for t in ("part", "events"))
    assert registry.QUERIES["src_cyclic_wrapped"](spark, SF).count() == 2 * parts + 1
    r = registry.QUERIES["stream_compare_all"](spark, SF).first()
    assert r.compared + r.missing == events - 10


def test_observation_diff_finds_each_layer(spark):
    a = registry.ev(spark, SF)
    found = lambda b: {r.layer: r.differences for r in quality.observation_diff(a, b).collect() if r.differences}
    assert found(registry.ev(spark, SF)) == {}
    assert found(registry.ev(spark, SF, "1/5")) == {"interval": 1}
    assert found(dataclasses.replace(a, tail=3, end=a.end - 1)) == {"span": 1, "tail": 1, "gaps": 1}
    assert found(a.select(F.col("f0").cast("double"))).keys() == {"schema", "records"}
    assert found(dataclasses.replace(a, df=a.df.where("n <> 7").selectExpr("n", "if(n = 9, null, if(n = 8, f0 + 1, f0)) as f0"))) == {"records": 2, "gaps": 1}
    rows = {r.layer: r for r in registry.QUERIES["observation_diff"](spark, SF).collect()}
    x = registry._damaged(S.interleave(a, registry.od(spark, SF)))
    assert rows["gaps"].differences == rows["gaps"].compared - x.trimmed().count() > 0 and rows["records"].differences == x.trimmed().where("n % 997 = 996").count() > 0
