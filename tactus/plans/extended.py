"""More queries: tails, workload families, provenance, rational numbers, rate conversion, and verdicts from bootstrap intervals."""

from __future__ import annotations

import dataclasses
import math
import uuid

from pyspark.sql import functions as F

from tactus.functions import expr
from tactus.operators import infer, measure, pipelines, quality
from tactus.operators import streams as S
from tactus.plans.registry import CENTS, EV, HOLES, OD, PT, R1, RUNS, WIN, _emb, ev, fir_sql, gather, holes, multirate_sql, od, out, pt, query, runs, size, table
from tactus.sources import artifacts, readers, records

# --- tails ---
TAILS = f"""WITH {EV}, {OD}, {PT}, s AS (SELECT {size('ev')} AS a, {size('od')} AS b, {size('pt')} AS c, (SELECT count(*) FROM embeddings) AS e),
  mix AS (SELECT n, n * 147 // 247 AS k, n * 147 // 247 = (n + 1) * 147 // 247 AS takes_right
    FROM (SELECT unnest(range(0, (SELECT least(a + ((a + 1) * 100 + 146) // 147, c + c * 147 // 100) FROM s))) AS n)),
  far AS (SELECT n, n * 2 // 3 AS k, n * 2 // 3 = (n + 1) * 2 // 3 AS takes_right
    FROM (SELECT unnest(range(0, (SELECT least(a + (a + 2) // 2, b * 3) FROM s))) AS n)),
  w AS (SELECT 'mix' AS node, n, CASE WHEN takes_right THEN ((n - k + 1) * 247 + 99) // 100 ELSE ((k + 1) * 247 + 146) // 147 END - 1 - n AS w FROM mix
    UNION ALL SELECT 'far', n, CASE WHEN takes_right THEN (n - k + 1) * 3 ELSE ((k + 1) * 3 + 1) // 2 END - 1 - n FROM far
    UNION ALL SELECT 'sum', n, ((n * 100 // 147 + 1) * 147 + 99) // 100 - 1 - n FROM ev WHERE n * 100 // 147 < (SELECT c FROM s)
    UNION ALL SELECT 'slow', n, (((n * 7 + 2) // 3 + 1) * 3 + 6) // 7 - 1 - n FROM ev WHERE (n * 7 + 2) // 3 < (SELECT a FROM s)
    UNION ALL SELECT 'win', n, ((n * 24 // 64 + 1) * 64 + 23) // 24 - 1 - n FROM (SELECT unnest(range(5, (SELECT (e * 64 + 23) // 24 FROM s))) AS n)),
  t AS (SELECT node, greatest(max(w), 0) AS tail, count(*) AS records, max(n) AS last_n FROM w GROUP BY node), f AS (SELECT tail FROM t WHERE node = 'far'),
  x AS (SELECT 'late' AS node, n, (((n * 5 + 1) // 2 + 1 + f.tail) * 2 + 4) // 5 - 1 - n AS w FROM far, f WHERE (n * 5 + 1) // 2 <= (SELECT max(n) FROM far)
    UNION ALL SELECT 'left', n, ((n + (n + 2) // 2 + 1 + f.tail) * 2 + 2) // 3 - 1 - n FROM far, f WHERE n + (n + 2) // 2 <= (SELECT max(n) FROM far)),
  u AS (SELECT node, greatest(max(w), 0) AS tail, count(*) AS records, max(n) AS last_n FROM x GROUP BY node)
  SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT 'held', greatest(tail - 1, 0), records, last_n + 1 FROM u WHERE node = 'late'"""


@query("tails", TAILS)
def _tails(s, d):
    """What each node of a plan waits, and the records that are there."""
    a, b, c = ev(s, d), od(s, d), pt(s, d)
    far = S.interleave(a, b)
    late = S.decimate(far, "1/6")
    nodes = {"mix": S.interleave(a, c), "far": far, "sum": S.add(a, c), "slow": S.decimate(a, "7/30"), "late": late, "held": S.shift(late, 1), "left": S.left_of(far, b.delta), "win": S.window_reduce(_emb(s, d), 24, 100, "sumc")}
    rows = [x.trimmed().agg(F.count("*").alias("records"), F.max("n").alias("last_n")).select(F.lit(k).alias("node"), F.lit(x.tail).cast("long").alias("tail"), "records", "last_n") for k, x in nodes.items()]
    return pipelines.union(rows)


@query("emission_mix", f"WITH {EV}, {OD}, {gather('ev', 'od', 1, 2, size('ev'), size('od'))} SELECT n, v, (n + 1 + 2) AS emit_num, 15::BIGINT AS emit_den FROM mix")
def _emission_mix(s, d):
    x = S.interleave(ev(s, d), od(s, d))
    return x.trimmed().join(S.emission_times(x), "n").select("n", F.col("f0").alias("v"), "emit_num", "emit_den")


# --- workload families ---
def family_sql(i: int, k: int, tail: str) -> str:
    first = "WHERE n > (SELECT coalesce(max(n), -1) FROM mix WHERE v IS NULL)"
    return f"WITH {EV}, {OD}, {R1.format(i, k)}, {gather('sa', 'sb', 1, 2, size('sa'), size('sb'))}, x AS (SELECT n, v FROM mix {first}) {tail}"


def _w1(s, d, i=2, k=1):
    return S.interleave(S.shift(ev(s, d), i), S.shift(od(s, d), k))


def copies(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q")


query("w1_shifted", family_sql(2, 1, "SELECT n, v FROM x"))(lambda s, d: out(_w1(s, d), "v"))
query("w2_copies", family_sql(2, 1, "SELECT n, v, q FROM x, (SELECT unnest(range(0, 8))::INTEGER AS q)"))(lambda s, d: out(_w1(s, d), "v").select("n", "v", copies(8)))
query("w6_nearmiss", family_sql(1, 1, "SELECT n, v FROM x"))(lambda s, d: out(_w1(s, d, 1, 1), "v"))


@query("w5_control", f"WITH {EV}, {OD}, {gather('ev', 'od', 1, 2, size('ev'), size('od'))} SELECT n, v * (q + 1) AS v, q FROM mix, (SELECT unnest(range(0, 4))::INTEGER AS q)")
def _w5(s, d):
    """Sources of their own for each result, nothing shared and nothing shifted: the tables are read once a result, as is this family's point."""
    one = lambda q: out(S.interleave(ev(s, d).select(F.col("f0") * (q + 1)), od(s, d).select(F.col("f0") * (q + 1))), "v").withColumn("q", F.lit(q))
    return pipelines.union([one(q) for q in range(4)])


@query("w7_materialised", family_sql(2, 1, "SELECT n, v FROM x"))
def _w7(s, d):
    """The shifted streams are stored before they are interleaved."""
    root = f"{readers.shared_folder(s)}/w7-{uuid.uuid4().hex}"
    for name, x in (("a", S.shift(ev(s, d), 2)), ("b", S.shift(od(s, d), 1))):
        artifacts.save_stream(x, f"{root}/{name}")
    return out(S.interleave(*[artifacts.load_stream(s, f"{root}/{name}") for name in "ab"]), "v")


TAPS45 = [(k * 11) % 29 - 12 for k in range(45)]
query("m2_fir", f"WITH {EV}, {fir_sql(TAPS45)} SELECT n, y // 45 // 1000 AS y FROM y WHERE y IS NOT NULL")(lambda s, d: out(pipelines.scaled_fir(ev(s, d, "1/1000"), TAPS45), "y"))

# --- rate conversion ---
def low_pass(half: int, cut: int) -> list[float]:
    """Taps of a sinc of 1 / ``cut`` of the band under a Hamming window, with sum 1."""
    at = range(-half, half + 1)
    h = [(math.sin(math.pi * k / cut) / (math.pi * k) if k else 1 / cut) * (0.54 + 0.46 * math.cos(math.pi * k / half)) for k in at]
    return [round(x / sum(h), 12) for x in h]


DOWN = low_pass(20, 2)
UP = [2 * x for x in DOWN]


def near_sql(taps: list[float], v: str, at) -> str:
    """Sum of taps[k] times the value at(k) records on, 0 outside the stream."""
    terms = [f"coalesce(lead({v}, {at(k)}) OVER (ORDER BY n), 0.0::DOUBLE) * ({t!r})::DOUBLE" for k, t in enumerate(taps) if at(k) is not None]
    return " + ".join(["0.0::DOUBLE", *terms])


_phase = lambda r: lambda k: (r + 20 - k) // 2 if (r + 20 - k) % 2 == 0 else None
ROUND_TRIP = f"""WITH {EV}, x AS (SELECT n, v::DOUBLE AS x FROM ev), y AS (SELECT n, x, {near_sql(UP, 'x', _phase(0))} AS y0, {near_sql(UP, 'x', _phase(1))} AS y1 FROM x),
  u AS (SELECT 2 * n AS n, y0 AS u FROM y UNION ALL SELECT 2 * n + 1, y1 FROM y), z AS (SELECT n, {near_sql(DOWN, 'u', lambda k: 20 - k)} AS z FROM u),
  e AS (SELECT x.n, z.z - x.x AS e FROM z JOIN x ON z.n = 2 * x.n), s AS (SELECT max(n) + 1 AS size, greatest(64, (max(n) + 1) // 20) AS margin FROM e)"""
query("resample_poly", f"{ROUND_TRIP} SELECT n, round(u, 4) AS u FROM u")(lambda s, d: S.resample(ev(s, d), 2, 1, UP).df.select("n", F.round("f0", 4).alias("u")))


@query("resample_roundtrip", f"{ROUND_TRIP} SELECT max(margin) AS margin, round(max(abs(e)), 4) AS max_full, round(sqrt(avg(e * e)), 4) AS rms_full, round(max(abs(e)) FILTER (WHERE n >= margin AND n < size - margin), 4) AS max_interior, round(sqrt(avg(e * e) FILTER (WHERE n >= margin AND n < size - margin)), 4) AS rms_interior FROM e, s")
def _round_trip(s, d):
    """Error of a conversion to twice the rate and back, over all records and without a margin."""
    x = ev(s, d)
    back = S.resample(S.resample(x, 2, 1, UP), 1, 2, DOWN)
    e = back.df.withColumnRenamed("f0", "z").join(x.df, "n").withColumn("e", F.col("z") - F.col("f0"))
    margin = max(64, x.end // 20)
    inner, norm = F.col("n").between(margin, x.end - margin - 1), lambda c: F.round(F.sqrt(F.avg(c * c)), 4)
    worst = lambda c: F.round(F.max(F.abs(c)), 4)
    return e.agg(worst(F.col("e")).alias("max_full"), norm(F.col("e")).alias("rms_full"), worst(F.when(inner, F.col("e"))).alias("max_interior"), norm(F.when(inner, F.col("e"))).alias("rms_interior")).withColumn("margin", F.lit(margin).cast("long"))


# --- provenance, rational numbers, consistency ---
UNIT = 10**12


@query("provenance", f"WITH {EV}, {PT}, {gather('ev', 'pt', 100, 147, size('ev'), size('pt'))} SELECT n, (takes_right)::INTEGER::BIGINT AS source, CASE WHEN takes_right THEN n - k ELSE k END AS record, 0::BIGINT AS place FROM g")
def _provenance(s, d):
    """Tagged sources through an interleave: each value tells where it is from."""
    tag = lambda x, i: x.select((F.lit(i + 1) * UNIT + F.col("n") * 10).cast("long"))
    return S.provenance(S.interleave(tag(ev(s, d), 0), tag(pt(s, d), 1)), unit=UNIT)


def _lowest(num: str, den: str, name: str) -> str:
    g = f"(gcd({num}, {den}) * sign({den}))"
    return f"CASE WHEN {den} <> 0 THEN ({num}) // {g} END::BIGINT AS {name}_num, CASE WHEN {den} <> 0 THEN ({den}) // {g} END::BIGINT AS {name}_den"


@query("rational_ops", f"WITH {EV}, x AS (SELECT n, v AS a, n % 7 + 1 AS b, u - 50 AS c, n % 5 - 2 AS e FROM ev), y AS (SELECT n, a, b, c // gcd(c, e) * sign(e) AS c, e // gcd(c, e) * sign(e) AS e FROM x WHERE e <> 0) SELECT n, {_lowest('(a * e + c * b)', '(b * e)', 'plus')}, {_lowest('(a * e - c * b)', '(b * e)', 'minus')}, {_lowest('(a * c)', '(b * e)', 'times')}, {_lowest('(a * e)', '(b * c)', 'over')} FROM y")
def _rational(s, d):
    x = ev(s, d, "1/10", F.col("user_id")).df
    x = x.select("n", expr.rational(F.col("f0"), F.col("n") % 7 + 1).alias("a"), expr.rational(F.col("f1") - 50, F.col("n") % 5 - 2).alias("b")).where("b is not null")
    ops = {"plus": expr.radd, "minus": expr.rsub, "times": expr.rmul, "over": expr.rdiv}
    x = x.select("n", *[f(F.col("a"), F.col("b")).alias(k) for k, f in ops.items()])
    return x.select("n", *[F.col(f"{k}.{p}").alias(f"{k}_{p}") for k in ops for p in ("num", "den")])


query("rate_consistency_checked", "WITH g AS (SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS k FROM lineitem GROUP BY 1) SELECT count(*) AS checked, count(*) FILTER (WHERE k > 1) AS problems, count(*) > 0 AND count(*) FILTER (WHERE k > 1) = 0 AS ok FROM g")(lambda s, d: quality.consistency(table(s, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"]))

# --- verdicts from bootstrap intervals; random draws, so no SQL: tests compare them with whole resamples ---
def _cells(s, d):
    return runs(s, d).select(F.concat_ws("-", "case", "task").alias("cell"), "profile", "ns")


@query("classify_bootstrap")
def _classify(s, d):
    """Class of every cell by the interval of its replicates."""
    return infer.bootstrap_ratio(_cells(s, d), "cell", "profile", "ns", "F", "O").select("cell", infer.classify(F.col("ratio"), F.col("lo"), F.col("hi")).alias("class"))


@query("equivalence_bootstrap")
def _equivalence(s, d):
    """Whether odd and even lines of a supplier differ alike under two return flags, rolled up by groups of suppliers."""
    x = runs(s, d).where("case in ('A', 'R')").select("task", F.concat("case", F.col("scale") % 2).alias("group"), "ns")
    r = infer.bootstrap_difference(x, "task", "group", "ns", ("A1", "A0", "R1", "R0"))
    return infer.equivalence(r.withColumn("grp", F.col("task") % 5), "grp")


# --- identities that hold for all intervals ---
query("rescaled", multirate_sql(1, 2, 2, 1, 30))(lambda s, d: out(pipelines.multirate(S.rescale(ev(s, d), "7/3"), S.rescale(od(s, d), "7/3"), 2, 1, 30), "v"))
query("unreduced_ratio", f"WITH {EV}, {OD}, {gather('ev', 'od', 3, 2, size('ev'), size('od'))} SELECT n, v, true AS same FROM mix")(lambda s, d: _unreduced(s, d))


def _unreduced(s, d):
    """6/4 beside 3/2: the same records at every index."""
    x, y = (out(S.interleave(ev(s, d, r), od(s, d, "1")), name) for r, name in (("6/4", "v"), ("3/2", "w")))
    return x.join(y, "n").select("n", "v", F.col("v").eqNullSafe(F.col("w")).alias("same"))


# --- files of records and lines, artifacts ---
def _folder(s, name: str) -> str:
    return f"{readers.shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query("src_records", f"WITH {EV} SELECT n, v, u FROM ev")
def _records(s, d):
    """All events written as records of fixed width and read by ranges of bytes."""
    path = _folder(s, "records")
    records.write_records(ev(s, d, "1/360", F.col("user_id")).df.withColumnsRenamed({"f0": "v", "f1": "u"}), path, "<qi", ["v", "u"])
    return records.binary_records(s, path, "<qi", ["v", "u"], split=1 << 18)


@query("src_lines", f"WITH {EV} SELECT n, {HOLES} AS v, u FROM ev")
def _lines(s, d):
    """All events written as lines without an index, numbered in file order."""
    path = _folder(s, "lines")
    x = holes(ev(s, d)).df.join(ev(s, d, "1/10", F.col("user_id")).df.select("n", "f1"), "n")
    line = F.concat_ws(" \t", F.coalesce(F.col("f0").cast("string"), F.lit("NULL")), F.col("f1").cast("string"))
    x.repartitionByRange("n").sortWithinPartitions("n").select(line).write.text(path)
    return records.numbered_lines(s, path, ["v", "u"], split=1 << 18)


@query("src_runs_mixed", f'WITH {RUNS} SELECT "case", task, scale, ns FROM l')
def _mixed_runs(s, d):
    """Tables of runs in three formats, with their columns in different orders, as one."""
    path, x = _folder(s, "runs"), runs(s, d).select("case", "task", "scale", "ns")
    one = lambda c: x.where(F.col("case") == c)
    one("A").write.csv(f"{path}/a.csv", header=True)
    one("N").select("ns", "scale", "task", "case").write.csv(f"{path}/n.tsv", header=True, sep="\t")
    one("R").write.json(f"{path}/r.jsonl")
    return readers.read_runs(s, [f"{path}/{f}" for f in ("a.csv", "n.tsv", "r.jsonl")], "case STRING, task LONG, scale LONG, ns LONG").drop("file")


def _probe_rows(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("iter"), F.expr(CENTS).alias("compute_ns"), F.col("user_id").alias("wake_lag_ns"), (F.expr(CENTS) + F.col("user_id")).alias("e2e_ns"))


@query("src_probe", f"WITH {EV} SELECT n AS iter, v AS compute_ns, u AS wake_lag_ns, v + u AS e2e_ns FROM ev")
def _probe_file(s, d):
    """A probe of all events, written as CSV and read back with its header and its number of rows checked."""
    path, x = _folder(s, "probe"), _probe_rows(s, d)
    x.write.csv(path, header=True)
    return readers.read_probe(s, path, x.count())


@query("src_commented", f"WITH {EV} SELECT 'rate=360 host=pi' AS meta, n AS iter, u AS wake_lag_ns FROM ev")
def _commented(s, d):
    """Probe files with lines of metadata before their header; rows carry what the metadata says."""
    path, x = _folder(s, "commented"), _probe_rows(s, d)
    head = s.createDataFrame([("# rate=360",), ("#host=pi",), ("iter,wake_lag_ns",)], "value string").coalesce(1)
    head.write.text(path)
    x.select(F.concat_ws(",", F.col("iter").cast("string"), F.col("wake_lag_ns").cast("string"))).write.mode("append").text(path)
    meta, rows = readers.read_commented_csv(s, path, "iter LONG, wake_lag_ns LONG")
    said = meta.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "key", "value")), asc=False), " ").alias("meta"), F.lit(1).alias("k"))
    return rows.withColumn("k", F.lit(1)).join(F.broadcast(said), "k").drop("k")  # said is one row


def _gappy(s, d):
    x = ev(s, d, "1/10", F.col("user_id"))
    return x.select(F.expr("case when n % 17 in (1, 5, 6, 7) then null else f0 end"), F.expr("case when n % 19 in (3, 7) then null else f1 end"))


@query("artifact_roundtrip", f"WITH {EV} SELECT n, {HOLES} AS v, CASE WHEN n % 19 IN (3, 7) THEN NULL ELSE u END AS u FROM ev")
def _artifact(s, d):
    """The stream as its artifact's second version gives it back."""
    path = _folder(s, "artifact")
    artifacts.save_stream(ev(s, d), path)
    artifacts.save_stream(_gappy(s, d), path)
    return out(artifacts.load_stream(s, path), "v", "u")


_islands = lambda i, where: f"SELECT {i}::INTEGER AS field, min(n) AS first, count(*) AS length FROM (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM ev WHERE {where}) GROUP BY g"


@query("artifact_null_index", f"WITH {EV} {_islands(0, 'n % 17 IN (1, 5, 6, 7) OR v IS NULL')} UNION ALL {_islands(1, 'n % 19 IN (3, 7) OR u IS NULL')}")
def _artifact_nulls(s, d):
    path = _folder(s, "artifact")
    artifacts.save_stream(_gappy(s, d), path)
    return artifacts.load_null_runs(s, path)


# --- comparisons ---
def _wide(s, d) -> tuple[S.Stream, S.Stream]:
    """The 64-wide stream, and a copy that lacks records and differs in single fields."""
    a = _emb(s, d)
    other = a.select(*[F.expr(f"case when n % 97 = 96 and n % 64 = {i} then f{i} + 1 else f{i} end") for i in range(64)])
    return a, dataclasses.replace(other, df=other.df.where("n % 101 <> 100"))


@query("record_compare", """WITH e AS (SELECT vec_id AS n, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 10000) AS BIGINT)) AS f FROM embeddings),
  b AS (SELECT n, list_transform(f, lambda x, i: CASE WHEN n % 97 = 96 AND n % 64 = i - 1 THEN x + 1 ELSE x END) AS g FROM e WHERE n % 101 <> 100),
  j AS (SELECT e.n, f, g, list_position(list_transform(list_zip(f, g), lambda z: z[1] IS DISTINCT FROM z[2]), true) - 1 AS place FROM e LEFT JOIN b USING (n)),
  d AS (SELECT * FROM j WHERE g IS NULL OR place >= 0 ORDER BY n LIMIT 1)
  SELECT count(g) AS compared, count(*) FILTER (WHERE g IS NOT NULL AND place >= 0) AS mismatches, count(*) - count(g) AS missing, count(*) FILTER (WHERE g IS NULL OR place >= 0) = 0 AS equal, (SELECT n FROM d) AS first_n,
    (SELECT CASE WHEN g IS NOT NULL THEN place END::BIGINT FROM d) AS first_position, (SELECT CASE WHEN g IS NOT NULL THEN f[place + 1] END::VARCHAR FROM d) AS first_a, (SELECT g[place + 1]::VARCHAR FROM d) AS first_b FROM j""")
def _record_compare(s, d):
    return quality.record_compare(*_wide(s, d))


@query("observation_materialised", f"WITH {EV} SELECT unnest(['interval', 'span', 'tail', 'schema', 'materialisation']) AS layer, 1::BIGINT AS compared, unnest([0, 0, 0, 1, 1]::BIGINT[]) AS differences UNION ALL SELECT 'records', count(*), 0 FROM ev UNION ALL SELECT 'gaps', count(*), 0 FROM ev")
def _materialised(s, d):
    """A stream beside its artifact in another type: values are equal, schema and materialisation differ."""
    a, paths = ev(s, d), (_folder(s, "artifact"), _folder(s, "artifact"))
    artifacts.save_stream(a, paths[0])
    artifacts.save_stream(a.select(F.col("f0").cast("decimal(20,0)")), paths[1])
    return quality.observation_diff(*[artifacts.load_stream(s, p) for p in paths], tuple(artifacts.descriptor(s, p) for p in paths))


# --- reports of runs ---
_at = lambda role, k: f"max({role}) FILTER (WHERE r_{role} = round_even({k} * (size - 1) / 1000.0::DOUBLE, 0)::BIGINT) AS {role}_p{k}"
REPORT = f"""WITH p AS (SELECT event_type AS run, event_id AS iter, CAST(round(value * 100) AS BIGINT) AS compute, user_id AS wake, CAST(round(value * 100) AS BIGINT) + user_id AS e2e FROM events),
  w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY iter) AS i, count(*) OVER (PARTITION BY run) AS every FROM p),
  k AS (SELECT *, count(*) OVER (PARTITION BY run) AS size, {', '.join(f'row_number() OVER (PARTITION BY run ORDER BY {m}) - 1 AS r_{m}' for m in ('compute', 'wake', 'e2e'))} FROM w WHERE i > every * 5 // 100)
  SELECT run, count(*) AS slots, floor(quantile_cont(compute, 0.5))::BIGINT AS compute_median, {_at('compute', 990)}, max(compute) AS compute_max, sum(compute)::BIGINT AS compute_sum, {_at('wake', 999)},
    {', '.join(_at('e2e', k) for k in (500, 990, 999))}, max(e2e) AS e2e_max FROM k GROUP BY run"""


@query("run_report", REPORT)
def _run_report(s, d):
    x = table(s, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("iter"), F.expr(CENTS).alias("compute"), F.col("user_id").alias("wake"))
    return measure.run_report(x.withColumn("e2e", F.col("compute") + F.col("wake")), "run", {"compute": "compute", "wake": "wake", "e2e": "e2e"}, "iter")


LADDER = f"""WITH {RUNS}, cell AS (SELECT "case", task, scale, max(ns) AS p99, 13000000 + 1000000 * scale AS slot, max(ns) <= 0.5 * (13000000 + 1000000 * scale) AS fits FROM l GROUP BY 1, 2, 3),
  fam AS (SELECT "case", count(DISTINCT task) AS every, min(scale) AS low FROM cell GROUP BY 1),
  whole AS (SELECT "case", max(scale) AS s FROM (SELECT "case", scale, bool_and(fits) AS ok, count(*) AS k FROM cell GROUP BY 1, 2) JOIN fam USING ("case") WHERE ok AND k = every GROUP BY 1),
  gone AS (SELECT cell.* FROM cell JOIN fam USING ("case") WHERE "case" NOT IN (SELECT "case" FROM whole) AND scale = low AND NOT fits),
  rest AS (SELECT cell.* FROM cell ANTI JOIN gone USING ("case", task)), held AS (SELECT "case", count(DISTINCT task) AS cases FROM rest GROUP BY 1),
  best AS (SELECT "case", max(scale) AS s FROM (SELECT "case", scale, bool_and(fits) AS ok, count(*) AS k FROM rest GROUP BY 1, 2) JOIN held USING ("case") WHERE ok AND k = cases GROUP BY 1)"""


def _ladder(s, d):
    return measure.ladder_ledger(runs(s, d).withColumn("slot", F.expr("13000000 + 1000000 * scale")), "case", "task", "scale", "ns", "slot")


query("ladder_rates", f'{LADDER} SELECT "case", coalesce(whole.s, best.s) AS scale, coalesce(cases, 0) AS cases, (SELECT count(*) FROM gone g WHERE g."case" = fam."case") AS excluded FROM fam LEFT JOIN whole USING ("case") LEFT JOIN held USING ("case") LEFT JOIN best USING ("case")')(lambda s, d: _ladder(s, d)[0])
query("ladder_ledger", f'{LADDER} SELECT "case", task, scale, p99, 0.5::DOUBLE * slot AS budget, 1e9::DOUBLE / slot AS stream_hz, 5e8::DOUBLE / p99 AS required_hz FROM gone')(lambda s, d: _ladder(s, d)[1])


# --- oracles of queries registered without one ---
def _oracle(name: str, sql: str) -> None:
    from tactus.plans.registry import ORACLES

    ORACLES[name] = sql


_hex = "('0x' || substr(md5(concat_ws('|', CAST(n AS VARCHAR), CAST(f0 AS VARCHAR))), 1, 8))::BIGINT"
_oracle("replay_determinism", f"WITH {EV}, w AS (SELECT n, {WIN('sum', 30, 's')} FROM ev), x AS (SELECT n, (s // 30)::BIGINT AS f0 FROM w WHERE n >= 29) SELECT count(*) AS rows, sum({_hex})::BIGINT AS digest, bit_xor({_hex}) AS mixed, 2::BIGINT AS runs FROM x")
_oracle("observation_diff", f"WITH {EV}, {OD}, {gather('ev', 'od', 1, 2, size('ev'), size('od'))} SELECT unnest(['interval', 'span', 'tail', 'schema']) AS layer, 1::BIGINT AS compared, 0::BIGINT AS differences UNION ALL SELECT 'records', count(*) FILTER (WHERE n % 1009 <> 1008), count(*) FILTER (WHERE n % 1009 <> 1008 AND n % 997 = 996) FROM mix UNION ALL SELECT 'gaps', count(*), count(*) FILTER (WHERE n % 1009 = 1008) FROM mix")
