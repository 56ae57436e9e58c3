"""Live operators beside the batch ones, over several batches, late records, repeated batches and readers."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tactus.functions import kernels
from tactus.operators import pipelines
from tactus.operators import streams as S
from tactus.plans.registry import TAPS25
from tactus.sources import readers
from tactus.streaming import live, probe, stateful, subscription


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Operators with state start a worker a partition and batch."""
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", had)


def stream(spark, delta, end, value="id * 37 % 1000 - 500", width=1):
    df = spark.range(end).select(F.col("id").alias("n"), *[F.expr(f"{value} + {i}").alias(f"f{i}") for i in range(width)])
    return S.Stream(df, Fraction(delta), width, 0, end)


def same(got, want):
    rows = lambda df: sorted(map(repr, df.collect()))
    return rows(got) == rows(want)


# --- the operator with state, without Spark ---
class Handle:
    """The state of one key."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def in_batches(compute, halo, outputs, batches, span, step=1):
    """Outputs, and the most records that any range held, of batches of (p, value or None)."""
    import pandas as pd

    handles, out, most = {}, [], 0
    for batch in batches:
        of = {}
        for p, v in batch:
            for at in range(p // span, (p + halo) // span + 1):
                of.setdefault(at, []).append((p, v or 0, v is not None))
        for at, rows in of.items():
            h = handles.setdefault(at, Handle())
            op = stateful.Halo(outputs, halo, compute, span, step, lambda at: at)
            op.init(h)
            frame = pd.DataFrame(rows, columns=["p", "v", "there"])
            for y in op.handleInputRows((at,), iter([frame]), None):
                out += [tuple(None if pd.isna(c) else int(c) for c in r) for r in y.itertuples(index=False)]
            most = max(most, len(h.value[0]) // 8 if h.value else 0)
    return out, most, handles


@pytest.mark.parametrize("seed", range(12))
def test_outputs_leave_once_in_any_order(seed):
    r = random.Random(seed)
    length, span, step = r.randint(1, 12), r.randint(13, 40), r.choice([1, 1, 3])
    values = {p: None if r.random() < 0.2 else r.randint(-99, 99) for p in range(150)}
    gone = set(r.sample(range(150), r.choice([0, 3])))
    rows = [(p, v) for p, v in values.items() if p not in gone]
    if seed % 2:
        r.shuffle(rows)
    batches = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    batches[-1] = batches[-1] * 2  # a record that comes twice in a batch counts once
    names = ("sumc", "avg", "min", "max", "count")
    got, _, handles = in_batches(kernels.reducers(length, names), length - 1, len(names), batches, span, step)
    want = []
    for p in range(length - 1, 150):
        if p % step or gone & set(range(p - length + 1, p + 1)):
            continue
        w = [values[q] for q in range(p - length + 1, p + 1) if values[q] is not None]
        want.append((p // step, *((sum(w), int(math.copysign(abs(sum(w)) // len(w), sum(w))), min(w), max(w)) if w else (None,) * 4), len(w)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert gone or all(h.value is None for at, h in handles.items() if at < 149 // span)


def test_state_holds_a_record_once():
    rows = [(p, p) for p in range(5_000)]
    _, most, handles = in_batches(kernels.reducers(180, ("avg",)), 179, 1, [rows[i : i + 500] for i in range(0, 5_000, 500)], 1_000)
    assert most <= 179 and all(h.value is None for at, h in handles.items() if at < 4)


# --- beside the batch form ---
def test_live_windows_equal_the_batch_form(spark, tmp_path):
    a = stream(spark, "1/360", 400, "if(id % 7 = 3, null, id * 37 % 1000 - 500)", width=2)
    live.record(a, f"file://{tmp_path}/a", "1/3", 3)
    got = live.collected(live.window_reduce(live.replayed(spark, f"file://{tmp_path}/a", a, a.end), 3, 10, "avg", "count", span=100).trimmed())
    assert got.count() > 200 and same(got, S.window_reduce(a, 3, 10, "avg", "count").trimmed())


def test_live_chain_needs_the_whole_halo(spark, tmp_path):
    a = stream(spark, "1/360", 900, "if(id = 640, null, id * 37 % 1000 - 500)")
    live.record(a, f"file://{tmp_path}/a", "1", 3)
    got = live.collected(live.qrs_features(live.replayed(spark, f"file://{tmp_path}/a", a), TAPS25, span=300))
    assert same(got, pipelines.qrs_features(a, TAPS25)) and got.count() == 640 - 236 + 900 - 640 - 237


def test_a_window_longer_than_a_range_is_refused(spark):
    with pytest.raises(ValueError):
        live.window_reduce(stream(spark, "1/360", 10), 1, 20, "avg", span=19)


# --- watermarks ---
RATES = [("1/360", "1/100"), ("1/360", "1/180"), ("3/7", "2/9"), ("1/10", "147/1000"), ("1", "1")]


def lags(x, count=400):
    """By definition: all pairs of records of which one is there before the other."""
    at = [(x.comes(n), n) for n in range(x.origin, x.origin + count)]
    return max((n - m) * x.delta for a, n in at for b, m in at if a < b)


@pytest.mark.parametrize(("da", "db"), RATES)
def test_disorder_equals_its_definition(spark, da, db):
    a, b = stream(spark, da, 50), stream(spark, db, 50)
    mix = S.interleave(S.shift(a, 2), b)
    nodes = [a, S.interleave(a, b), mix, S.shift(mix, 3), S.left_of(S.interleave(a, b), b.delta), S.decimate(mix, mix.delta * Fraction(7, 3)), S.add(a, b)]
    for x in nodes:
        assert live.disorder(x) == max(0, lags(x))
        assert all(x.comes(n + x.period) - x.comes(n) == x.period * x.delta for n in range(x.origin, x.origin + 20))
        assert all(x.comes(n) <= (n + 1 + x.tail) * x.delta for n in range(x.origin, x.origin + 50))


@pytest.mark.parametrize(("da", "db"), RATES)
def test_least_delay_is_the_least(spark, da, db):
    """Under the rule of watermarks in milliseconds, nothing is late with the least delay; something is with one less (two where no worst record is on a whole one)."""
    x = S.interleave(stream(spark, da, 50), stream(spark, db, 50))
    at = sorted((x.comes(n), live.slot_micros(n, x.delta)) for n in range(3_000 if x.delta < 1 else 300))

    def late(delay):
        top, held, found = 0, 0, 0
        for i, (t, slot) in enumerate(at):
            if i and t > at[i - 1][0]:
                top = max(top, held)
            found += top > 0 and slot <= (top // 1000 - delay) * 1000
            held = max(held, slot)
        return found

    wait = live.least_delay(x)
    less = wait - (1 if "360" in da else 2)
    assert late(wait) == 0 and (late(less) > 0 or less <= 0)


def test_a_record_is_late_only_under_the_least_delay(spark, tmp_path):
    a, b = stream(spark, "1/360", 72), stream(spark, "1/100", 20)
    x = S.interleave(a, b)
    pairs = [(live.slot_micros(n, x.delta) // 1000 - live.slot_micros(m, x.delta) / 1000, x.comes(n)) for n in range(90) for m in range(n) if x.comes(n) < x.comes(m)]
    lag, cut = max(pairs)
    wait = live.least_delay(x)
    assert wait - 1 <= lag < wait
    for i, s in enumerate((a, b)):
        live.record(s, f"file://{tmp_path}/{i}", cut, 1)  # all; split below, with an empty batch between
        rows = spark.read.parquet(f"file://{tmp_path}/{i}")
        for part in (F.col("n") < math.floor(cut / s.delta), F.lit(False), F.col("n") >= math.floor(cut / s.delta)):
            rows.where(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/cut{i}")
    count = {}
    for delay in (wait, wait - 1):
        mix = S.interleave(*[live.replayed(spark, f"file://{tmp_path}/cut{i}", s, s.end) for i, s in enumerate((a, b))])
        count[delay] = live.collected(live.window_reduce(mix, 1, 1, "sumc", delay=delay).trimmed()).count()
    assert count[wait] == x.trimmed().count() > count[wait - 1]


def test_rate_aligned_sums_of_live_streams(spark, tmp_path):
    for da, db, ends in [("1/10", "147/1000", (300, 200)), ("2/9", "1/10", (100, 200)), ("1/10", "1/10", (90, 90))]:
        a, b = stream(spark, da, ends[0], width=2), stream(spark, db, ends[1], "id * 5")
        root = f"file://{tmp_path}/{ends[0]}"
        for name, s in (("a", a), ("b", b)):
            live.record(s, f"{root}/{name}", "10", 3)
        got = live.collected(live.add(*[live.replayed(spark, f"{root}/{name}", s, s.end) for name, s in (("a", a), ("b", b))]).trimmed())
        assert same(got, S.add(a, b).trimmed())


def test_joined_state_is_dropped(spark, tmp_path):
    """Behind the watermark the join holds nothing, however much has passed."""
    a, b = stream(spark, "1/10", 900), stream(spark, "1/5", 450)
    for name, s in (("a", a), ("b", b)):
        live.record(s, f"file://{tmp_path}/{name}", "30", 3)
    j = live.add(*[live.replayed(spark, f"file://{tmp_path}/{name}", s) for name, s in (("a", a), ("b", b))]).df
    q = j.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 900 and held[-1] <= 4


# --- subscriptions ---
def test_readers_have_places_of_their_own(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    batches = [spark.range(a, b).selectExpr("id as n", "id * 2 as f0") for a, b in ((0, 10), (10, 25), (25, 30))]
    for i, x in enumerate(batches[:2]):
        subscription.append(x, root, i)
    subscription.append(batches[1], root, 1)  # run again: adds nothing
    of = lambda name: subscription.Reader(spark, root, name, batches[0].schema)
    ids = lambda df: sorted(r.n for r in df.collect())
    assert of("a").unread() == 25 and ids(of("a").take(7)) == list(range(7)) and ids(of("a").take(8)) == list(range(7, 15))
    assert ids(of("b").take()) == list(range(25)) and ids(of("b").take()) == [] and of("b").place() == (1, 24)
    subscription.append(batches[2], root, 2)
    assert ids(of("b").take(3)) == [25, 26, 27] and ids(of("a").take(100)) == list(range(15, 30)) and ids(of("a").take(0)) == []
    assert of("new").place() == (-1, -1) and of("b").unread() == 2
    # A batch that hasn't been written to its end isn't there, and neither is a move.
    (tmp_path / "log/rows/batch=2/_SUCCESS").unlink()
    assert of("new").unread() == 25


def test_nothing_to_read(spark, tmp_path):
    assert subscription.Reader(spark, f"file://{tmp_path}/none", "a", readers.StructType.fromDDL("n long, f0 long")).take(5).count() == 0


# --- probe ---
def test_progress_becomes_a_probe(spark, tmp_path):
    a = stream(spark, "1/10", 60)
    live.record(a, f"file://{tmp_path}/a", "2", 3)
    listener = probe.ProbeListener(spark, "probed", f"file://{tmp_path}/probe", flush=2)
    spark.streams.addListener(listener)
    try:
        q = live.replayed(spark, f"file://{tmp_path}/a", a).df.writeStream.queryName("probed").format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        assert listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    rows = sorted(readers.read_probe(spark, f"file://{tmp_path}/probe", 3).collect())
    assert [r.iter for r in rows] == [0, 1, 2] and all(0 < r.compute_ns <= r.e2e_ns and r.wake_lag_ns == 0 for r in rows)
