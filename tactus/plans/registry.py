"""All queries of the library and their SQL oracles, by name.

Spark computes by scattering source records to output indexes and by bucketed windows; the oracles gather: for each output
index they look the source record up, or use one unbucketed window.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import expr
from tactus.operators import eventlog, infer, measure, pipelines, quality
from tactus.operators import streams as S
from tactus.sources import readers
from tactus.streaming import live, subscription

TAPS26 = [(k * 7) % 23 - 9 for k in range(26)]
TAPS25 = [(k * 5) % 17 - 6 for k in range(25)]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CENTS = "cast(round(value * 100) as bigint)"
EV = "ev AS (SELECT event_id AS n, CAST(round(value * 100) AS BIGINT) AS v, user_id AS u FROM events)"
OD = "od AS (SELECT o_orderkey AS n, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"
PT = "pt AS (SELECT p_partkey AS n, CAST(p_size AS BIGINT) AS v FROM part)"
HOLES = "CASE WHEN n % 17 IN (1, 5, 6, 7) THEN NULL ELSE v END"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark, d, delta="1/10", *more):
    return S.from_table(table(spark, d, "events"), "event_id", [F.expr(CENTS), *more], delta)


def od(spark, d, delta="1/5"):
    return S.from_table(table(spark, d, "orders"), "o_orderkey", [F.expr("cast(round(o_totalprice * 100) as bigint)")], delta)


def pt(spark, d, delta="147/1000"):
    return S.from_table(table(spark, d, "part"), "p_partkey", [F.expr("cast(p_size as bigint)")], delta)


def holes(s: S.Stream) -> S.Stream:
    return s.select(F.expr("case when n % 17 in (1, 5, 6, 7) then null else f0 end"))


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def out(s: S.Stream, *names: str) -> DataFrame:
    return s.trimmed().select("n", *[F.col(f).alias(x) for f, x in zip(s.fields, names or s.fields, strict=True)])


def gather(a: str, b: str, u: int, v: int, na: str, nb: str, first: str = "0", fields: str = "v") -> str:
    """SQL of an interleave by its definition: for each n, which side and which record."""
    end = f"least({na} + (({na} + 1) * {u} + {v - 1}) // {v}, {nb} + ({nb} * {v}) // {u})"
    return f"""g AS (SELECT n, (n * {v}) // {u + v} AS k, (n * {v}) // {u + v} = ((n + 1) * {v}) // {u + v} AS takes_right
      FROM (SELECT unnest(range({first}, (SELECT {end}))) AS n)),
    mix AS (SELECT g.n, coalesce(a.v, b.v) AS v FROM g LEFT JOIN {a} a ON NOT takes_right AND a.n = g.k LEFT JOIN {b} b ON takes_right AND b.n = g.n - g.k)"""


def size(name: str) -> str:
    return f"(SELECT max(n) + 1 FROM {name})"


# --- sources and sinks ---
query("src_cyclic", f"WITH {PT} SELECT r.n, pt.v AS v FROM (SELECT unnest(range(0, 5000)) AS n) r JOIN pt ON pt.n = r.n % {size('pt')}")(lambda s, d: out(S.cyclic(pt(s, d), 5000), "v"))
query("src_cyclic_wrapped", f"WITH {PT} SELECT r.n, pt.v AS v FROM (SELECT unnest(range(0, 2 * {size('pt')} + 1)) AS n) r JOIN pt ON pt.n = r.n % {size('pt')}")(lambda s, d: out(_wrapped(pt(s, d)), "v"))
query("src_synthetic", f"WITH {EV} SELECT n, ((n * 37) % 1000 - 500)::BIGINT AS f0, (n + 1)::BIGINT AS f1, (2000000 + n * 10)::BIGINT AS f2 FROM ev")(lambda s, d: table(s, d, "events").select(F.col("event_id").alias("n"), F.expr("event_id * 37 % 1000 - 500").alias("f0"), F.expr("event_id + 1").alias("f1"), F.expr("2000000 + event_id * 10").alias("f2")))
query("validate_table", "SELECT 'not_empty' AS rule, (CASE WHEN count(*) = 0 THEN 1 ELSE 0 END)::BIGINT AS violations FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (WHERE NOT coalesce(l_quantity > 5, false)) FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)) FROM lineitem")(lambda s, d: readers.validate_table(table(s, d, "lineitem"), {"quantity": "l_quantity > 5", "flag": "l_returnflag in ('A', 'N')"}))
query("log_counters", """SELECT event_type, 'k' AS counter, max(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT)) AS value, count(*) FILTER (WHERE regexp_matches(props, '"k": \\d+')) AS hits FROM events GROUP BY event_type""")(lambda s, d: readers.log_counters(table(s, d, "events"), "event_type", "props", {"k": '"k": (\\d+)'}))
query("canonical_long", f"WITH {EV} SELECT 'F' AS family, 'spark' AS variant, n AS logical_index, 'out_0' AS field_name, CAST({HOLES} AS VARCHAR) AS value, (CASE WHEN {HOLES} IS NULL THEN 1 ELSE 0 END)::INTEGER AS is_null, 0::INTEGER AS is_gap FROM ev")(lambda s, d: S.canonical_long(holes(ev(s, d)), "F", "spark"))
query("checksum_index", "SELECT event_type, count(*) AS rows, sum(('0x' || substr(md5(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR))), 1, 8))::BIGINT)::BIGINT AS digest, bit_xor(('0x' || substr(md5(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR))), 1, 8))::BIGINT) AS mixed FROM events GROUP BY event_type")(lambda s, d: quality.checksum(table(s, d, "events"), ["event_type"], ["event_id", "user_id"]))

# --- expressions ---
query("pass", f"WITH {EV} SELECT n, v AS f0 FROM ev")(lambda s, d: out(ev(s, d)))
query("field_name", f"WITH {EV} SELECT n, u FROM ev")(lambda s, d: out(ev(s, d, "1/10", F.col("user_id")).select(F.col("f1")), "u"))
query("field_index", "SELECT vec_id AS n, CAST(round(embedding[4]::DOUBLE * 10000) AS BIGINT) AS v FROM embeddings")(lambda s, d: table(s, d, "embeddings").select(F.col("vec_id").alias("n"), F.expr("cast(round(cast(embedding[3] as double) * 10000) as bigint)").alias("v")))
query("zip_broadcast", "WITH e AS (SELECT vec_id AS n, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 10000) AS BIGINT)) AS f FROM embeddings), z AS (SELECT a.n, list_zip(a.f, b.f) AS z FROM e a JOIN e b ON b.n = a.n - 1) SELECT n, list_sum(list_transform(z, lambda x: x[1] * x[2]))::BIGINT AS dot, z[1][1] * z[1][2] AS first FROM z")(lambda s, d: _zip(s, d))
query("expr_arith", f"WITH {EV}, x AS (SELECT n, v, {HOLES} AS h FROM ev) SELECT n, h + v AS plus, h - v AS minus, h * 3 AS times FROM x")(lambda s, d: _with_holes(s, d).select("n", (F.col("h") + F.col("f0")).alias("plus"), (F.col("h") - F.col("f0")).alias("minus"), (F.col("h") * 3).alias("times")))
query("expr_idiv", f"WITH {EV} SELECT n, (v - 5000) // nullif(n % 7 - 3, 0) AS q FROM ev")(lambda s, d: out(ev(s, d).select(expr.idiv(F.col("f0") - 5000, F.col("n") % 7 - 3)), "q"))
query("range_check", f"WITH {OD} SELECT n, v * 300 AS product, greatest(least(v * 300, 2147483647), -2147483648) AS saturated FROM od WHERE abs(v * 300) > 2147483647")(lambda s, d: out(od(s, d).select(F.col("f0") * 300)).where(expr.out_of_range(F.col("f0"))).select("n", F.col("f0").alias("product"), expr.saturate(F.col("f0")).alias("saturated")))
query("expr_promote", f"WITH {EV} SELECT n, CAST(v AS DOUBLE) + CAST(u AS DOUBLE) / 2 AS x FROM ev")(lambda s, d: ev(s, d, "1/10", F.col("user_id")).df.select("n", (expr.promote(F.col("f0"), expr.promoted("integer", "double")) + expr.promote(F.col("f1"), "double") / 2).alias("x")))
query("monitors_q8", f"WITH {EV} SELECT n, {', '.join(f'v + {i} AS m{i}' for i in range(8))} FROM ev")(lambda s, d: out(pipelines.monitors(ev(s, d), 8), *[f"m{i}" for i in range(8)]))


def _wrapped(x: S.Stream) -> S.Stream:
    return S.cyclic(x, 2 * x.end + 1)


def _zip(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("n"), F.expr("transform(embedding, x -> cast(round(cast(x as double) * 10000) as bigint))").alias("f"))
    z = e.join(e.select((F.col("n") + 1).alias("n"), F.col("f").alias("g")), "n").select("n", expr.zip_fields(F.col("f"), F.col("g"), lambda a, b: a * b).alias("z"))
    return z.select("n", expr.sumc(F.col("z")).alias("dot"), F.get("z", F.lit(0)).alias("first"))


def _with_holes(s, d):
    x = ev(s, d).df
    return x.withColumn("h", F.expr("case when n % 17 in (1, 5, 6, 7) then null else f0 end"))


# --- stream algebra ---
MIX12 = gather("ev", "od", 1, 2, size("ev"), size("od"))
query("shift", f"WITH {EV} SELECT n + 7 AS n, v FROM ev")(lambda s, d: out(S.shift(ev(s, d), 7), "v"))
query("interleave", f"WITH {EV}, {OD}, {MIX12} SELECT n, v FROM mix")(lambda s, d: out(S.interleave(ev(s, d), od(s, d)), "v"))
query("interleave_merge", f"WITH {EV}, {PT}, t AS (SELECT (n + 1) * 100 AS t, 0 AS tie, v FROM ev UNION ALL SELECT n * 147, 1, v FROM pt), r AS (SELECT row_number() OVER (ORDER BY t, tie) - 1 AS n, v FROM t) SELECT n, v FROM r WHERE n < least({size('ev')} + (({size('ev')} + 1) * 100 + 146) // 147, {size('pt')} + ({size('pt')} * 147) // 100)")(lambda s, d: out(S.interleave(ev(s, d), pt(s, d)), "v"))
query("interleave_phase", f"WITH {OD}, {EV}, {gather('od', 'ev', 3, 2, size('od'), size('ev'))} SELECT n % 5 AS phase, count(*) AS records, sum(v)::BIGINT AS total FROM mix GROUP BY 1")(lambda s, d: S.interleave(od(s, d, "3/10"), ev(s, d, "1/5")).trimmed().groupBy((F.col("n") % 5).alias("phase")).agg(F.count("*").alias("records"), F.sum("f0").alias("total")))
query("deinterleave_left", f"WITH {EV}, {OD}, {MIX12} SELECT a.n, m.v FROM (SELECT unnest(range(0, {size('ev')})) AS n) a JOIN mix m ON m.n = a.n + ((a.n + 1) + 1) // 2")(lambda s, d: out(S.left_of(S.interleave(ev(s, d), od(s, d)), "1/5"), "v"))
query("deinterleave_right", f"WITH {EV}, {OD}, {MIX12} SELECT b.n, m.v FROM (SELECT unnest(range(0, {size('od')})) AS n) b JOIN mix m ON m.n = b.n + b.n * 2")(lambda s, d: out(S.right_of(S.interleave(ev(s, d), od(s, d)), "1/10"), "v"))
query("add_equal", f"WITH {EV}, {OD} SELECT ev.n, ev.v AS a, od.v AS b FROM ev JOIN od USING (n)")(lambda s, d: out(S.add(ev(s, d), od(s, d, "1/10")), "a", "b"))
query("add_rate", f"WITH {EV}, {PT} SELECT ev.n, ev.v AS a, pt.v AS b FROM ev JOIN pt ON pt.n = ev.n * 100 // 147")(lambda s, d: out(S.add(ev(s, d), pt(s, d)), "a", "b"))
query("add_nary", f"WITH {EV}, {OD}, {PT} SELECT ev.n, ev.v AS a, od.v AS b, pt.v AS c FROM ev JOIN od USING (n) JOIN pt ON pt.n = ev.n")(lambda s, d: out(S.add(S.add(ev(s, d), od(s, d, "1/10")), pt(s, d, "1/10")), "a", "b", "c"))
query("add_coef", f"WITH {EV} SELECT n, v AS f0, 3::BIGINT AS f1, -4::BIGINT AS f2 FROM ev")(lambda s, d: out(S.with_constants(ev(s, d), [3, -4])))
query("decimate", f"WITH {EV} SELECT r.n, ev.v FROM (SELECT unnest(range(0, {size('ev')})) AS n) r JOIN ev ON ev.n = (r.n * 7 + 2) // 3")(lambda s, d: out(S.decimate(ev(s, d), "7/30"), "v"))
WIN = lambda f, size, alias="v": f"{f}(v) OVER (ORDER BY n ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS {alias}"
query("window_slide", f"WITH {EV}, w AS (SELECT n, {WIN('list', 5, 'f')} FROM ev) SELECT n, list_reverse(f)::VARCHAR AS f FROM w WHERE n >= 4")(lambda s, d: _window_text(S.window(ev(s, d), 1, 5)))
query("window_mirror", f"WITH {EV}, w AS (SELECT n, {WIN('list', 5, 'f')} FROM ev) SELECT n, f::VARCHAR AS f FROM w WHERE n >= 4")(lambda s, d: _window_text(S.window(ev(s, d), 1, -5)))
query("window_step", f"WITH {EV}, w AS (SELECT n, {WIN('sum', 7, 's')}, {WIN('max', 7, 'm')} FROM ev) SELECT n // 3 AS n, s::BIGINT AS s, m FROM w WHERE n % 3 = 0 AND n >= 6")(lambda s, d: out(S.window_reduce(ev(s, d), 3, 7, "sumc", "max", bucket=500), "s", "m"))
query("window_tumbling", f"WITH {EV}, w AS (SELECT n, {WIN('sum', 10, 's')} FROM ev) SELECT n // 10 AS n, s::BIGINT AS s FROM w WHERE n % 10 = 0 AND n >= 9")(lambda s, d: out(S.window_reduce(ev(s, d), 10, 10, "sumc", bucket=700), "s"))
query("window_wide", "WITH p AS (SELECT vec_id * 64 + i AS p, CAST(round(embedding[i + 1]::DOUBLE * 10000) AS BIGINT) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i)), w AS (SELECT p, sum(v) OVER (ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s FROM p) SELECT p // 24 AS n, s::BIGINT AS s FROM w WHERE p % 24 = 0 AND p >= 99")(lambda s, d: out(S.window_reduce(_emb(s, d), 24, 100, "sumc", bucket=900), "s"))
REDUCE = "WITH e AS (SELECT vec_id AS n, unnest(embedding) AS x FROM embeddings), v AS (SELECT n, CAST(round(x::DOUBLE * 10000) AS BIGINT) AS v FROM e) SELECT n, {0} AS v FROM v GROUP BY n"
for _name, _sql in {"sumc": "sum(v)::BIGINT", "avg": "(sum(v) // count(v))::BIGINT", "min": "min(v)", "max": "max(v)"}.items():
    query(f"reduce_{_name}", REDUCE.format(_sql))(lambda s, d, r=_name: out(S.reduce_fields(_emb(s, d), r), "v"))
query("reduce_avg_nulls", f"WITH {EV}, h AS (SELECT n, {HOLES} AS v FROM ev), w AS (SELECT n, {WIN('sum', 6, 's')}, {WIN('count', 6, 'c')} FROM h) SELECT n, (s // nullif(c, 0))::BIGINT AS v FROM w WHERE n >= 5")(lambda s, d: out(S.window_reduce(holes(ev(s, d)), 1, 6, "avg"), "v"))
query("reduce_avg_exact", f"WITH {EV}, h AS (SELECT n, {HOLES} AS v FROM ev), w AS (SELECT n, {WIN('sum', 6, 's')}, {WIN('count', 6, 'c')} FROM h) SELECT n, s::BIGINT AS num, c AS den FROM w WHERE n >= 5")(lambda s, d: out(S.window_reduce(holes(ev(s, d)), 1, 6, "sumc", "count"), "num", "den"))
SHIFTED = "sa AS (SELECT n + 2 AS n, v FROM ev), sb AS (SELECT n + 4 AS n, v FROM od)"
query("origin_trim", f"WITH {EV}, {OD}, {SHIFTED}, {gather('sa', 'sb', 1, 2, size('sa'), size('sb'))} SELECT n, v FROM mix WHERE n > (SELECT max(n) FROM mix WHERE v IS NULL)")(lambda s, d: out(S.interleave(S.shift(ev(s, d), 2), S.shift(od(s, d), 4)), "v"))
query("emission_time", f"WITH {EV} SELECT n, (n + 1) * 147 AS emit_num, 1000::BIGINT AS emit_den FROM (SELECT p_partkey AS n FROM part)")(lambda s, d: S.emission_times(pt(s, d)))
def _emb(s, d):
    e = table(s, d, "embeddings")
    return S.from_table(e, "vec_id", [F.expr(f"cast(round(cast(embedding[{i}] as double) * 10000) as bigint)") for i in range(64)], "1/10")


def _window_text(w: S.Stream) -> DataFrame:
    return w.trimmed().select("n", F.concat(F.lit("["), F.array_join("f0", ", ", "NULL"), F.lit("]")).alias("f"))


# --- identities ---
R1 = "sa AS (SELECT n + {0} AS n, v FROM ev), sb AS (SELECT n + {1} AS n, v FROM od)"


def _identity(s, d, i, k):
    a, b = ev(s, d), od(s, d)
    x, y = S.interleave(S.shift(a, i), S.shift(b, k)), S.shift(S.interleave(a, b), i + k)
    first, last = max(x.origin, y.origin), min(x.end, y.end)
    return quality.stream_compare(x.trimmed(), y.trimmed(), first, last - first).select("compared", "mismatches")


def _identity_sql(i: int, k: int, first: int) -> str:
    g = gather("sa", "sb", 1, 2, size("sa"), size("sb"))
    base = gather("ev", "od", 1, 2, size("ev"), size("od")).replace("g AS", "g2 AS").replace("mix AS", "plain AS").replace("FROM g ", "FROM g2 g ").replace("SELECT g.n", "SELECT g.n")
    return f"WITH {EV}, {OD}, {R1.format(i, k)}, {g}, {base} SELECT count(*) AS compared, count(*) FILTER (WHERE x.v <> y.v) AS mismatches FROM (SELECT n, v FROM mix WHERE n > coalesce((SELECT max(n) FROM mix WHERE v IS NULL), -1)) x JOIN plain y ON x.n = y.n + {i + k}"


query("identity_r1", _identity_sql(2, 1, 3))(lambda s, d: _identity(s, d, 2, 1))
query("identity_r1_nearmiss", _identity_sql(2, 2, 4))(lambda s, d: _identity(s, d, 2, 2))
query("shared_subplan", f"WITH {EV}, {OD} SELECT ev.n, ev.v + od.v AS ab, od.v + ev.v AS ba, (od.v + ev.v = ev.v + od.v) AS same FROM ev JOIN od USING (n)")(lambda s, d: out(S.add(ev(s, d), od(s, d, "1/10")).select(F.col("f0") + F.col("f1"), F.col("f1") + F.col("f0"), F.col("f0") + F.col("f1") == F.col("f1") + F.col("f0")), "ab", "ba", "same"))
query("roundtrip_exact", f"WITH {EV}, {OD} SELECT 'left' AS side, count(*) AS compared, 0::BIGINT AS mismatches FROM ev WHERE n + (n + 2) // 2 < least({size('ev')} + ({size('ev')} + 2) // 2, {size('od')} * 3) UNION ALL SELECT 'right', count(*), 0 FROM od WHERE n * 3 < least({size('ev')} + ({size('ev')} + 2) // 2, {size('od')} * 3)")(lambda s, d: _roundtrip(s, d))


def _roundtrip(s, d):
    a, b = ev(s, d), od(s, d)
    c = S.interleave(a, b)
    left, right = S.left_of(c, b.delta), S.right_of(c, a.delta)
    one = lambda name, x, y: quality.stream_compare(x.trimmed(), y.trimmed(), 0, x.end).select(F.lit(name).alias("side"), "compared", "mismatches")
    return one("left", left, a).unionByName(one("right", right, b))


@query("replay_determinism")
def _replay(s, d):
    digest = lambda parts: quality.checksum(out(S.window_reduce(ev(s, d), 1, 30, "avg", bucket=parts)).withColumn("g", F.lit(1)), ["g"], ["n", "f0"])
    return digest(700).unionByName(digest(100_000)).groupBy("rows", "digest", "mixed").agg(F.count("*").alias("runs"))


# --- pipelines ---
def fir_sql(taps: list[int], source: str = "ev", name: str = "y", v: str = "v") -> str:
    terms = " + ".join(f"lag({v}, {k}) OVER (ORDER BY n) * ({c})" for k, c in enumerate(taps))
    return f"{name} AS (SELECT n, {terms} AS y FROM {source})"


FIR = f"WITH {EV}, {OD}, {fir_sql(TAPS26)}, f AS (SELECT n, y // 26 // 1000 AS y FROM y WHERE y IS NOT NULL)"
query("fir", f"{FIR} SELECT n, y FROM f")(lambda s, d: out(pipelines.scaled_fir(ev(s, d, "1/1000"), TAPS26), "y"))
query("fir_with_source", f"{FIR} SELECT n, y, v FROM f JOIN ev USING (n)")(lambda s, d: out(pipelines.fir_with_source(ev(s, d, "1/1000"), TAPS26), "y", "v"))
QRS = f"""WITH {EV}, {fir_sql(TAPS25, 'ev', 'b0')}, b AS (SELECT n, y // 1000 AS v FROM b0 WHERE y IS NOT NULL),
  {fir_sql(pipelines.DERIVATIVE, 'b', 'd')}, q AS (SELECT n, y * y // 1000 AS v FROM d WHERE y IS NOT NULL),
  m0 AS (SELECT n, {WIN('sum', 30, 's')}, {WIN('count', 30, 'c')} FROM q), m AS (SELECT n, (s // 30)::BIGINT AS v FROM m0 WHERE c = 30),
  t0 AS (SELECT n, v, {WIN('sum', 180, 's')}, {WIN('count', 180, 'c')} FROM m), t AS (SELECT n, v AS mwi, (s // 180)::BIGINT AS thr FROM t0 WHERE c = 180)"""
query("qrs_features", f"{QRS} SELECT n, v - 900 AS out_0, mwi * 5 AS out_1, (mwi - thr * 2) * 5 AS out_2 FROM t JOIN ev USING (n)")(lambda s, d: pipelines.qrs_features(ev(s, d, "1/360"), TAPS25))
query("qrs_detect", f"{QRS} SELECT n, v - 900 AS out_0, u - 900 AS out_1, (mwi - thr * 2) * 5 AS out_2 FROM t JOIN ev USING (n)")(lambda s, d: pipelines.qrs_detect(ev(s, d, "1/360", F.col("user_id")), TAPS25))
_lagf = lambda v, cs: " + ".join(["0.0::DOUBLE"] + [f"coalesce(lag({v}, {k}) OVER (ORDER BY n), 0.0::DOUBLE) * ({c})::DOUBLE" for k, c in enumerate(reversed(cs))])
query("qrs_float", f"WITH {EV}, a AS (SELECT n, ({_lagf('v::DOUBLE', TAPS25)}) / 1000 AS bp FROM ev), b AS (SELECT n, {_lagf('bp', pipelines.DERIVATIVE)} AS d FROM a), c AS (SELECT n, d * d / 1000 AS v FROM b), e AS (SELECT n, {WIN('sum', 30, 's')} FROM c), f AS (SELECT n, s / 30 AS v FROM e), g AS (SELECT n, v, {WIN('sum', 180, 's')} FROM f) SELECT n, round(v, 4) AS mwi, round(s / 180, 4) AS thr FROM g")(lambda s, d: pipelines.qrs_float(ev(s, d, "1/360"), TAPS25).select("n", F.round("mwi", 4).alias("mwi"), F.round("thr", 4).alias("thr")))


def multirate_sql(u: int, v: int, i: int, k: int, length: int, tail: str = "SELECT n, v FROM r") -> str:
    return f"WITH {EV}, {OD}, {R1.format(i, k)}, {gather('sa', 'sb', u, v, size('sa'), size('sb'))}, x AS (SELECT n, v FROM mix WHERE n > (SELECT max(n) FROM mix WHERE v IS NULL)), w AS (SELECT n, {WIN('sum', length, 's')}, {WIN('count', length, 'c')} FROM x), r AS (SELECT n, (s // {length})::BIGINT AS v FROM w WHERE c = {length}) {tail}"


query("multirate", multirate_sql(1, 2, 2, 1, 30))(lambda s, d: out(pipelines.multirate(ev(s, d), od(s, d), 2, 1, 30), "v"))
query("m1_fir", f"{FIR} SELECT n, y, od.v AS x2 FROM f JOIN od USING (n)")(lambda s, d: out(S.add(pipelines.scaled_fir(ev(s, d, "1/1000"), TAPS26), od(s, d, "1/1000")), "y", "x2"))
query("m1_multirate", multirate_sql(1, 2, 2, 1, 30, "SELECT r.n, r.v, od.v AS aux FROM r JOIN od ON od.n = r.n // 3"))(lambda s, d: out(S.add(pipelines.multirate(ev(s, d), od(s, d), 2, 1, 30), od(s, d)), "v", "aux"))
query("m2_multirate", multirate_sql(1, 2, 2, 1, 45))(lambda s, d: out(pipelines.multirate(ev(s, d), od(s, d), 2, 1, 45), "v"))
query("m3_multirate", multirate_sql(5, 12, 12, 5, 30))(lambda s, d: out(pipelines.multirate(ev(s, d, "1/12"), od(s, d), 12, 5, 30), "v"))
query("m4_monitors", f"{FIR} SELECT n, {', '.join(f'y + {i} AS q{i}' for i in range(8))} FROM f")(lambda s, d: out(pipelines.monitors(pipelines.scaled_fir(ev(s, d, "1/1000"), TAPS26), 8), *[f"q{i}" for i in range(8)]))
NEST = f"WITH {EV}, {OD}, {PT}, {MIX12}, {gather('mix', 'pt', 1, 3, 'least(' + size('ev') + ' + (' + size('ev') + ' + 2) // 2, ' + size('od') + ' * 3)', size('pt')).replace('g AS', 'h AS', 1).replace('mix AS', 'deep AS').replace('FROM g ', 'FROM h g ')}"
query("w3_nested", f"{NEST} SELECT n, v FROM deep")(lambda s, d: out(S.interleave(S.interleave(ev(s, d), od(s, d)), pt(s, d, "1/5")), "v"))
query("w4_window", f"WITH {EV}, w AS (SELECT n, {WIN('sum', 30, 's')} FROM ev), a AS (SELECT n, (s // 30)::BIGINT AS v FROM w WHERE n >= 29) SELECT n, {', '.join(f'v + {i} AS q{i}' for i in range(8))} FROM a")(lambda s, d: out(pipelines.monitors(S.window_reduce(ev(s, d, "1/15"), 1, 30, "avg"), 8), *[f"q{i}" for i in range(8)]))
query("w8_monitor", f"{QRS}, sa AS (SELECT n + 29 AS n, v FROM ev), sb AS (SELECT n + 29 AS n, v FROM m), {gather('sa', 'sb', 1, 1, size('sa'), size('sb'))} SELECT n, v FROM mix WHERE n > (SELECT max(n) FROM mix WHERE v IS NULL)")(lambda s, d: _w8(s, d))
query("w9_wide", f"WITH {EV}, {OD} SELECT ev.n, {', '.join(f'(ev.v + {k}) * (od.v + {k}) AS p{k}' for k in range(16))} FROM ev JOIN od ON od.n = ev.n // 2")(lambda s, d: _w9(s, d))
query("resample_norms", f"WITH {EV}, {OD}, e AS (SELECT n, ev.v - od.v AS x FROM ev JOIN od USING (n)) SELECT max(abs(x))::BIGINT AS max_full, round(sqrt(avg(x::DOUBLE * x)), 6) AS rms_full, max(abs(x)) FILTER (WHERE n >= 100 AND n < (SELECT max(n) + 1 FROM e) - 100)::BIGINT AS max_interior, round(sqrt(avg(x::DOUBLE * x) FILTER (WHERE n >= 100 AND n < (SELECT max(n) + 1 FROM e) - 100)), 6) AS rms_interior FROM e")(lambda s, d: _norms(s, d, 100))


def _w8(s, d):
    e = ev(s, d, "1/360")
    q = pipelines.qrs_chain(e, TAPS25)
    first = 24 + 4 + 29  # the short average needs no long one
    mwi = S.fir(e, TAPS25).select(expr.idiv(F.col("f0"), 1000))
    sq = S.fir(mwi, pipelines.DERIVATIVE)
    sq = sq.select(expr.idiv(F.col("f0") * F.col("f0"), 1000))
    m = S.window_reduce(sq, 1, 30, "avg")
    assert m.origin == first and q is not None
    return out(S.interleave(S.shift(e, 29), S.shift(m, 29)), "v")


def _w9(s, d):
    x = S.add(ev(s, d), od(s, d))
    return out(x.select(*[(F.col("f0") + k) * (F.col("f1") + k) for k in range(16)]), *[f"p{k}" for k in range(16)])


def _norms(s, d, margin):
    x = S.add(ev(s, d), od(s, d, "1/10")).select(F.col("f0") - F.col("f1"))
    e, inner = F.col("f0"), F.col("n").between(margin, x.end - margin - 1)
    rms = lambda c: F.round(F.sqrt(F.avg(c.cast("double") * c)), 6)
    return x.df.agg(F.max(F.abs(e)).alias("max_full"), rms(e).alias("rms_full"), F.max(F.when(inner, F.abs(e))).alias("max_interior"), rms(F.when(inner, e)).alias("rms_interior"))


# --- quality ---
query("null_coverage", f"WITH {EV}, x AS (SELECT {HOLES} AS a, CASE WHEN n % 19 IN (3, 7) THEN NULL ELSE u END AS b FROM ev) SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS present, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS partial_null, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS all_null FROM x")(lambda s, d: quality.null_coverage(_with_holes(s, d).join(ev(s, d).select(F.expr("case when n % 19 in (3, 7) then null else 1 end")).df.withColumnRenamed("f0", "b"), "n"), ["h", "b"]))
query("gap_runs", f"WITH {EV}, x AS (SELECT n FROM ev WHERE {HOLES} IS NULL), g AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM x) SELECT min(n) AS first, count(*) AS length, count(*) > 2 AS is_gap FROM g GROUP BY g")(lambda s, d: quality.runs(_with_holes(s, d), F.col("h").isNull(), 1000).withColumn("is_gap", F.col("length") > quality.NULL_FILL))
query("stream_compare", f"WITH {EV}, b AS (SELECT n, CASE WHEN n % 997 = 996 THEN v + 1 ELSE v END AS v FROM ev WHERE n % 1009 <> 1008), j AS (SELECT a.n, a.v AS a, b.v AS b, b.n AS m FROM ev a LEFT JOIN b USING (n) WHERE a.n BETWEEN 10 AND 9009) SELECT count(m) AS compared, count(*) FILTER (WHERE m IS NOT NULL AND a <> b) AS mismatches, 9000 - count(m) AS missing, min(n) FILTER (WHERE m IS NULL OR a <> b) AS first_bad, arg_min_null(a, n) FILTER (WHERE m IS NULL OR a <> b) AS first_a, arg_min_null(b, n) FILTER (WHERE m IS NULL OR a <> b) AS first_b FROM j")(lambda s, d: quality.stream_compare(ev(s, d).df, ev(s, d).df.where("n % 1009 <> 1008").withColumn("f0", F.expr("case when n % 997 = 996 then f0 + 1 else f0 end")), 10, 9000))
query("stream_compare_all", f"WITH {EV}, b AS (SELECT n, CASE WHEN n % 997 = 996 THEN v + 1 ELSE v END AS v FROM ev WHERE n % 1009 <> 1008), j AS (SELECT a.n, a.v AS a, b.v AS b, b.n AS m FROM ev a LEFT JOIN b USING (n) WHERE a.n >= 10) SELECT count(m) AS compared, count(*) FILTER (WHERE m IS NOT NULL AND a <> b) AS mismatches, {size('ev')} - 10 - count(m) AS missing, min(n) FILTER (WHERE m IS NULL OR a <> b) AS first_bad, arg_min_null(a, n) FILTER (WHERE m IS NULL OR a <> b) AS first_a, arg_min_null(b, n) FILTER (WHERE m IS NULL OR a <> b) AS first_b FROM j")(lambda s, d: quality.stream_compare(ev(s, d).df, _damaged(ev(s, d)).df, 10, ev(s, d).end - 10))
query("interleave_picks", f"WITH {EV}, {PT}, {gather('ev', 'pt', 100, 147, size('ev'), size('pt'))} SELECT n // 247 AS period, count(*) FILTER (WHERE takes_right) AS from_b, count(*) FILTER (WHERE NOT takes_right) AS from_a FROM g GROUP BY 1")(lambda s, d: S.interleave(ev(s, d).select(F.lit(0)), pt(s, d).select(F.lit(1))).trimmed().groupBy(F.expr("n div 247").alias("period")).agg(F.sum("f0").cast("long").alias("from_b"), F.count_if(F.col("f0") == 0).alias("from_a")))
CHANGED = "r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT -doc_id - 1, n_chars FROM documents WHERE doc_id % 50 = 0)"
query("corpus_diff", f"WITH {CHANGED} SELECT CASE WHEN r.doc_id IS NULL THEN 'only_left' WHEN l.doc_id IS NULL THEN 'only_right' WHEN l.n_chars = r.n_chars THEN 'identical' ELSE 'changed' END AS status, count(*) AS n FROM documents l FULL JOIN r ON l.doc_id = r.doc_id GROUP BY 1")(lambda s, d: quality.corpus_diff(table(s, d, "documents"), _changed(s, d), "doc_id", "n_chars"))
STATUS = "CASE l_linenumber % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'open' ELSE 'pass' END"
query("status_transitions", "WITH a AS (SELECT doc_id, ['fail', 'open', 'pass'][(n_chars % 3)::INT + 1] AS b, ['fail', 'open', 'pass'][((n_chars + doc_id) % 3)::INT + 1] AS a FROM documents) SELECT b AS before, a AS after, count(*) AS n, CASE WHEN a > b THEN 'improvement' WHEN a < b THEN 'regression' ELSE 'same' END AS kind FROM a GROUP BY 1, 2")(lambda s, d: _transitions(s, d))
query("reconcile", f"WITH {CHANGED} SELECT doc_id, 'only_a' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT doc_id, 'only_b' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'differs' FROM documents d JOIN r USING (doc_id) WHERE d.n_chars <> r.n_chars")(lambda s, d: quality.reconcile(table(s, d, "documents"), _changed(s, d), "doc_id", "n_chars"))
query("set_equality", "WITH a AS (SELECT DISTINCT l_returnflag AS f, l_linenumber AS k FROM lineitem WHERE l_linenumber <= 5), b AS (SELECT DISTINCT l_returnflag AS f, l_linenumber AS k FROM lineitem WHERE l_linenumber >= 3 AND l_returnflag <> 'A') SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")(lambda s, d: quality.set_equality(*[table(s, d, "lineitem").where(c).select(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("k")).distinct() for c in ("l_linenumber <= 5", "l_linenumber >= 3 and l_returnflag <> 'A'")]))
query("checksum_consistency", "SELECT event_type, count(DISTINCT md5(props)) AS variants, count(*) AS checked FROM events GROUP BY 1 HAVING count(DISTINCT md5(props)) > 1")(lambda s, d: quality.inconsistent(table(s, d, "events").withColumn("digest", F.md5("props")), ["event_type"], ["digest"]))
query("rate_consistency", "SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS variants, count(*) AS checked FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")(lambda s, d: quality.inconsistent(table(s, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"]))
query("set_diff_counts", "WITH bad AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1), x AS (SELECT l_suppkey, l_partkey, max((l_linestatus = 'F')::INT) AS x, max((l_linestatus = 'O')::INT) AS y FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM bad) GROUP BY 1, 2) SELECT l_suppkey, count(*) FILTER (WHERE y > x) AS added, count(*) FILTER (WHERE x > y) AS removed, sum(y - x)::BIGINT AS net FROM x GROUP BY 1")(lambda s, d: quality.set_difference_counts(table(s, d, "lineitem"), "l_suppkey", "l_partkey", "l_linestatus", "F", "O", F.expr("l_quantity >= 50 and l_discount >= 0.1")))
query("expected_check", "WITH o AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), e AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE count(DISTINCT event_type) + 95 END AS expected FROM events GROUP BY 1) SELECT user_id, n, expected FROM o JOIN e USING (user_id) WHERE expected IS NOT NULL AND n <> expected")(lambda s, d: _expected(s, d))
query("observation_diff")(lambda s, d: quality.observation_diff(S.interleave(ev(s, d), od(s, d)), _damaged(S.interleave(ev(s, d), od(s, d)))))


def _damaged(x: S.Stream) -> S.Stream:
    """A copy that lacks some records and differs in others."""
    return replace(x, df=x.df.where("n % 1009 <> 1008").withColumn("f0", F.expr("case when n % 997 = 996 then f0 + 1 else f0 end")))


def _changed(s, d):
    t = table(s, d, "documents").select("doc_id", "n_chars")
    return t.where("doc_id % 11 <> 0").withColumn("n_chars", F.expr("case when doc_id % 7 = 0 then n_chars + 1 else n_chars end")).unionByName(t.where("doc_id % 50 = 0").withColumn("doc_id", -F.col("doc_id") - 1))


def _transitions(s, d):
    t, at = table(s, d, "documents"), lambda e: F.element_at(F.array(*map(F.lit, ("fail", "open", "pass"))), (F.expr(e) % 3 + 1).cast("int"))
    return quality.status_transitions(t.select("doc_id", at("n_chars").alias("st")), t.select("doc_id", at("n_chars + doc_id").alias("st")), "doc_id", "st", ["fail", "open", "pass"])


def _expected(s, d):
    t = table(s, d, "events")
    o = t.groupBy("user_id").agg(F.count("*").alias("n"))
    e = t.groupBy("user_id").agg(F.count_distinct("event_type").alias("k")).select("user_id", F.expr("case when user_id % 3 = 0 then null else k + 95 end").alias("expected"))
    return quality.expected_check(o, e, "user_id", "n")


# --- measurement ---
def probe(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("iter"), F.expr(CENTS).alias("ns"))


def runs(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("case"), F.col("l_linestatus").alias("profile"), F.col("l_linenumber").cast("long").alias("scale"), F.col("l_suppkey").alias("task"), F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("ns"), F.expr("cast(l_quantity as bigint)").alias("qty"))


PROBE = "p AS (SELECT event_type AS run, event_id AS iter, CAST(round(value * 100) AS BIGINT) AS ns FROM events)"
RUNS = 'l AS (SELECT l_returnflag AS "case", l_linestatus AS profile, l_linenumber::BIGINT AS scale, l_suppkey AS task, CAST(round(l_extendedprice * 100) AS BIGINT) AS ns, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)'
RANK = "k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ns) - 1 AS rn, count(*) OVER (PARTITION BY run) AS size FROM p)"
query("warmup_trim", f"WITH {PROBE}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY iter) AS rn, count(*) OVER (PARTITION BY run) AS size FROM p) SELECT run, iter, ns FROM k WHERE rn > size * 5 // 100")(lambda s, d: measure.warmup_trim(probe(s, d), "run", "iter"))
query("percentile_nearest", f"WITH {PROBE}, {RANK} SELECT run, {', '.join(f'max(ns) FILTER (WHERE rn = round_even({k} * (size - 1) / 1000.0::DOUBLE, 0)::BIGINT) AS p{k}' for k in (500, 990, 999))} FROM k GROUP BY run")(lambda s, d: measure.percentile_nearest(probe(s, d), "run", "ns", [500, 990, 999]))
query("percentile_floor", f"WITH {PROBE}, {RANK} SELECT run, {', '.join(f'max(ns) FILTER (WHERE rn = least(size - 1, size * {k} // 100)) AS p{k}' for k in (50, 95, 99))} FROM k GROUP BY run")(lambda s, d: measure.percentile_floor(probe(s, d), "run", "ns", [50, 95, 99]))
query("run_summary", f"WITH {PROBE}, {RANK} SELECT run, count(*) AS slots, quantile_cont(ns, 0.5)::DOUBLE AS median, max(ns) AS largest, sum(ns)::BIGINT AS total, {', '.join(f'max(ns) FILTER (WHERE rn = round_even({k} * (size - 1) / 1000.0::DOUBLE, 0)::BIGINT) AS p{k}' for k in (990, 999))} FROM k GROUP BY run")(lambda s, d: measure.run_summary(probe(s, d), "run", "ns"))
query("budget_report", f"WITH {PROBE} SELECT run, round(100 * max(ns) / 9000.0::DOUBLE, 6) AS max_percent, max(ns) <= 9000 AS fits, round(1e9::DOUBLE / (sum(ns)::DOUBLE / count(*)), 3) AS per_s_mean, round(1e9::DOUBLE / quantile_cont(ns, 0.5)::DOUBLE, 3) AS per_s_median FROM p GROUP BY run")(lambda s, d: measure.budget_report(probe(s, d), "run", "ns", 9000))
query("overrun_share", f"WITH {PROBE} SELECT run, (count(*) FILTER (WHERE ns > 3000))::DOUBLE / count(*) AS share FROM p GROUP BY run")(lambda s, d: measure.overrun_share(probe(s, d), "run", "ns", 3000))
query("rate_ceiling", f'WITH {RUNS}, r AS (SELECT task, scale, bool_and(qty <= 49) AS ok FROM l GROUP BY 1, 2) SELECT task, max(scale) FILTER (WHERE ok) AS ceiling FROM r GROUP BY 1')(lambda s, d: measure.rate_ceiling(runs(s, d), "task", "scale", F.expr("qty <= 49")))
query("ladder_select", f'WITH {RUNS}, o AS (SELECT "case", task, scale, bool_and(qty <= 49) AS ok FROM l GROUP BY 1, 2, 3), lo AS (SELECT "case", min(scale) AS low FROM o GROUP BY 1), x AS (SELECT o."case", o.task FROM o JOIN lo USING ("case") WHERE scale = low AND NOT ok), p AS (SELECT "case", scale, bool_and(ok) AS ok, count(*) AS cases FROM o WHERE ("case", task) NOT IN (SELECT "case", task FROM x) GROUP BY 1, 2) SELECT "case", max(scale) AS scale, arg_max(cases, scale) AS cases FROM p WHERE ok GROUP BY 1')(lambda s, d: measure.ladder_select(runs(s, d), "case", "task", "scale", F.expr("qty <= 49")))
query("budget_violations", f'WITH {RUNS}, b AS (SELECT "case", max(ns) + 100000 AS slot FROM l GROUP BY 1) SELECT "case", profile, worst, slot FROM (SELECT "case", profile, max(ns) AS worst FROM l GROUP BY 1, 2) JOIN b USING ("case") WHERE 2 * worst > slot')(lambda s, d: measure.budget_violations(runs(s, d), "case", "profile", "ns", runs(s, d).groupBy("case").agg((F.max("ns") + 100000).alias("slot"))))
query("profile_pivot", f'WITH {RUNS} SELECT "case", quantile_cont(ns, 0.5) FILTER (WHERE profile = \'F\')::DOUBLE AS F, quantile_cont(ns, 0.5) FILTER (WHERE profile = \'O\')::DOUBLE AS O FROM l GROUP BY 1')(lambda s, d: measure.profile_pivot(runs(s, d), "case", "profile", "ns", ["F", "O"]))
_iqr = lambda k: f"(max(ns) FILTER (WHERE rn = (size + 1) * {k} // 4) + (max(ns) FILTER (WHERE rn = (size + 1) * {k} // 4 + 1) - max(ns) FILTER (WHERE rn = (size + 1) * {k} // 4)) * max(((size + 1) * {k} % 4) / 4.0::DOUBLE))::DOUBLE"
query("iqr_exclusive", f"WITH {PROBE}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ns) AS rn, count(*) OVER (PARTITION BY run) AS size FROM p) SELECT run, {_iqr(1)} AS q1, {_iqr(3)} AS q3, {_iqr(3)} - {_iqr(1)} AS iqr FROM k GROUP BY run")(lambda s, d: measure.iqr_exclusive(probe(s, d), "run", "ns"))
query("relative_change", f"WITH {RUNS}, a AS (SELECT task, sum(ns)::BIGINT AS o FROM l WHERE profile = 'F' GROUP BY 1), b AS (SELECT task, sum(ns)::BIGINT AS n FROM l WHERE profile = 'O' GROUP BY 1) SELECT task, o AS old, n AS new, round((n - o)::DOUBLE / o, 9) AS change FROM a JOIN b USING (task)")(lambda s, d: measure.relative_change(*[runs(s, d).where(F.col("profile") == p).groupBy("task").agg(F.sum("ns").alias("ns")) for p in ("F", "O")], "task", "ns"))
query("metrics_avg", "SELECT count(*) AS rows, count(TRY_CAST(nullif(CASE WHEN event_id % 5 = 0 THEN 'NA' ELSE CAST(user_id AS VARCHAR) END, 'NA') AS BIGINT)) AS temps, round(avg(user_id) FILTER (WHERE event_id % 5 <> 0), 9) AS temp FROM events")(lambda s, d: table(s, d, "events").withColumn("t", F.expr("try_cast(case when event_id % 5 = 0 then 'NA' else cast(user_id as string) end as bigint)")).agg(F.count("*").alias("rows"), F.count("t").alias("temps"), F.round(F.avg("t"), 9).alias("temp")))
query("class_verdict", "WITH x AS (SELECT event_type AS kind, (event_id % 5 - 2)::BIGINT AS gap, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY kind, gap ORDER BY event_id) AS rn FROM x) SELECT kind, gap, count(*) AS n, min(event_id) FILTER (WHERE rn = 1) AS first, min(event_id) FILTER (WHERE rn = 2) AS second, CASE WHEN gap = 0 THEN 'exact' WHEN gap > 0 THEN 'over' ELSE 'under' END AS regime FROM r GROUP BY 1, 2")(lambda s, d: measure.class_verdict(table(s, d, "events").select(F.col("event_type").alias("kind"), F.expr("event_id % 5 - 2").alias("gap"), "event_id"), "kind", "gap", "event_id"))
query("divergence_share", "SELECT count(DISTINCT l_orderkey) AS groups, count(DISTINCT CASE WHEN l_quantity > 45 THEN l_orderkey END) AS diverging, count(DISTINCT CASE WHEN l_quantity > 45 THEN l_orderkey END)::DOUBLE / count(DISTINCT l_orderkey) AS share FROM lineitem")(lambda s, d: measure.divergence_share(table(s, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 45))
query("win_table", f'WITH {RUNS}, p AS (SELECT "case", task, sum(ns) FILTER (WHERE profile = \'F\') AS a, sum(ns) FILTER (WHERE profile = \'O\') AS b FROM l GROUP BY 1, 2) SELECT "case", count(*) AS tasks, count(*) FILTER (WHERE a < b) AS wins, count(*) FILTER (WHERE a < b) * 2 > count(*) AS majority FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1')(lambda s, d: measure.win_table(runs(s, d), "case", "task", "profile", "ns", "F", "O"))

# --- events ---
query("tail_events", f"WITH {PROBE} SELECT run, iter, ns, iter / 360.0::DOUBLE AS at_s FROM p WHERE ns >= 5000")(lambda s, d: eventlog.tail_events(probe(s, d), "ns", 5000, 360))
query("event_gaps", f"WITH {PROBE}, g AS (SELECT run, iter - lag(iter) OVER (PARTITION BY run ORDER BY iter) AS gap FROM p WHERE ns >= 3000) SELECT run, min(gap) AS least, quantile_cont(gap, 0.5)::DOUBLE AS median, max(gap) AS largest FROM g WHERE gap IS NOT NULL GROUP BY run")(lambda s, d: eventlog.event_gaps(probe(s, d).where("ns >= 3000"), "run", "iter"))
TIMES = "t AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events)"
query("coincidence", f"WITH {TIMES}, a AS (SELECT * FROM t WHERE event_type = 'purchase'), b AS (SELECT t FROM t WHERE event_type = 'error') SELECT event_id, t FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.t BETWEEN a.t - 60000000 AND a.t + 60000000)")(lambda s, d: eventlog.coincidence(*_roles(s, d), "t", 60_000_000))
query("coincidence_report", f"WITH {TIMES}, w AS (SELECT * FROM t WHERE t BETWEEN 1704153600000000 AND 1705363200000000), a AS (SELECT t FROM w WHERE event_type = 'purchase'), b AS (SELECT t FROM w WHERE event_type = 'error'), c AS (SELECT (SELECT count(*) FROM a) AS events_a, (SELECT count(*) FROM b) AS events_b, (SELECT count(*) FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.t BETWEEN a.t - 60000000 AND a.t + 60000000)) AS coincident) SELECT *, CASE WHEN events_a = 0 AND events_b = 0 THEN 'none' WHEN events_b = 0 THEN 'only_a' WHEN events_a = 0 THEN 'only_b' WHEN coincident > 0 THEN 'shared' ELSE 'independent' END AS verdict FROM c")(lambda s, d: eventlog.coincidence_report(*_roles(s, d), "t", 60_000_000, 1704153600000000, 1705363200000000))
query("phase_profile", f"WITH {PROBE} SELECT iter % 25 AS phase, count(*) AS n, quantile_cont(ns, 0.5)::DOUBLE AS median, max(ns) AS largest FROM p GROUP BY 1")(lambda s, d: eventlog.phase_profile(probe(s, d), 25, "ns"))
query("phase_excess", f"WITH {PROBE} SELECT quantile_cont(ns, 0.5) FILTER (WHERE iter % 25 = 24)::DOUBLE AS edge_median, quantile_cont(ns, 0.5)::DOUBLE AS median, quantile_cont(ns, 0.5) FILTER (WHERE iter % 25 = 24)::DOUBLE - quantile_cont(ns, 0.5)::DOUBLE AS excess FROM p")(lambda s, d: eventlog.phase_excess(probe(s, d), 25, "ns"))


def _roles(s, d):
    t = table(s, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return [t.where(F.col("event_type") == r).select("event_id", "t") for r in ("purchase", "error")]


# --- inference ---
query("bootstrap_ratio")(lambda s, d: infer.bootstrap_ratio(runs(s, d).select(F.concat_ws("-", "case", "task").alias("cell"), "profile", "ns"), "cell", "profile", "ns", "F", "O"))
query("bootstrap_point", f'WITH {RUNS}, m AS (SELECT "case", quantile_cont(ns, 0.5) FILTER (WHERE profile = \'F\') AS a, quantile_cont(ns, 0.5) FILTER (WHERE profile = \'O\') AS b FROM l GROUP BY 1) SELECT "case", round(a::DOUBLE / b::DOUBLE, 9) AS ratio FROM m WHERE b <> 0 AND a IS NOT NULL')(lambda s, d: measure.profile_pivot(runs(s, d), "case", "profile", "ns", ["F", "O"]).where("O <> 0 and F is not null").select("case", F.round(F.col("F") / F.col("O"), 9).alias("ratio")))
query("classify_ratio", f"WITH {RUNS}, a AS (SELECT task, (sum(ns) FILTER (WHERE profile = 'F'))::DOUBLE / (sum(ns) FILTER (WHERE profile = 'O')) AS r FROM l GROUP BY 1) SELECT task, CASE WHEN r <= 0.9 AND r * 1.05 < 1 THEN 'A' WHEN r >= 1.1 AND r * 0.95 > 1 THEN 'C' ELSE 'B' END AS class FROM a WHERE r IS NOT NULL")(lambda s, d: _ratios(s, d).select("task", infer.classify(F.col("r"), F.col("r") * 0.95, F.col("r") * 1.05).alias("class")))
query("least_squares", f"WITH {RUNS}, x AS (SELECT qty::DOUBLE AS a, scale::DOUBLE AS b, ns::DOUBLE / 100 AS y FROM l), g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM x) SELECT 'qty' AS feature, round((ay * bb - byy * ab) / (aa * bb - ab * ab), 4) AS coefficient, (ay * bb - byy * ab) / (aa * bb - ab * ab) < 0 AS negative FROM g UNION ALL SELECT 'scale', round((byy * aa - ay * ab) / (aa * bb - ab * ab), 4), (byy * aa - ay * ab) / (aa * bb - ab * ab) < 0 FROM g")(lambda s, d: _fit(s, d))
query("mare", f'WITH {RUNS} SELECT "case", count(*) AS n, round(avg(abs(qty * 150000.0::DOUBLE - ns) / abs(ns)), 9) AS mare FROM l GROUP BY 1')(lambda s, d: infer.mare(runs(s, d), "case", F.col("qty") * 150000.0, F.col("ns")))
query("feature_join", f'WITH {RUNS} SELECT "case", scale, total, n FROM (SELECT "case", scale, sum(ns)::BIGINT AS total FROM l WHERE profile = \'O\' GROUP BY 1, 2) JOIN (SELECT "case", scale, count(*) AS n FROM l GROUP BY 1, 2) USING ("case", scale)')(lambda s, d: infer.feature_join(runs(s, d).where("profile = 'O'").groupBy("case", "scale").agg(F.sum("ns").alias("total")), runs(s, d).groupBy("case", "scale").agg(F.count("*").alias("n")), ["case", "scale"]))
query("equivalence_test", f"WITH {RUNS}, a AS (SELECT task, (sum(ns) FILTER (WHERE profile = 'F'))::DOUBLE / (sum(ns) FILTER (WHERE profile = 'O')) AS r FROM l GROUP BY 1), v AS (SELECT task % 5 AS grp, CASE WHEN r - 1 - 0.005 > -0.02 AND r - 1 + 0.005 < 0.02 THEN 'n' WHEN r - 1 - 0.005 > 0.02 OR r - 1 + 0.005 < -0.02 THEN 'e' ELSE 'u' END AS v FROM a WHERE r IS NOT NULL) SELECT grp, count(*) AS cells, bool_and(v = 'n') AS none, bool_or(v = 'e') AS any_effect FROM v GROUP BY 1")(lambda s, d: infer.equivalence(_ratios(s, d).select((F.col("task") % 5).alias("grp"), (F.col("r") - 1 - 0.005).alias("lo"), (F.col("r") - 1 + 0.005).alias("hi")), "grp"))
query("counter_rate", f"WITH {RUNS}, w AS (SELECT task, sum(qty) FILTER (WHERE scale = 4) AS hi, sum(qty) FILTER (WHERE scale = 1) AS lo FROM l GROUP BY 1) SELECT task, (hi - lo)::DOUBLE / 3.0::DOUBLE AS rate, hi < lo AS is_error FROM w WHERE hi IS NOT NULL AND lo IS NOT NULL")(lambda s, d: infer.counter_rate(runs(s, d), "task", "scale", "qty", 1, 4))


def _ratios(s, d):
    t = lambda p: F.sum(F.when(F.col("profile") == p, F.col("ns"))).cast("double")
    return runs(s, d).groupBy("task").agg((t("F") / t("O")).alias("r")).where("r is not null")


def _fit(s, d):
    x = runs(s, d).withColumn("y", F.col("ns") / 100)
    a, b = infer.least_squares(x, ["qty", "scale"], "y")
    one = x.agg(F.count("*").alias("rows"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.lit(c), 4).alias("coefficient"), F.lit(c < 0).alias("negative")) for n, c in (("qty", a), ("scale", b))])).alias("x")).select("x.*")


# --- streaming ---
def _live(s, d, name="events"):
    if name == "events":
        return live.live_table(s, f"{d}/events.parquet", "event_id", CENTS)
    if name == "part":
        return live.live_table(s, f"{d}/part.parquet", "p_partkey", "cast(p_size as bigint)")
    return live.live_table(s, f"{d}/orders.parquet", "o_orderkey", "cast(round(o_totalprice * 100) as bigint)")


def _live_stream(s, d, name, delta):
    batch = {"events": ev, "orders": od, "part": pt}[name](s, d)
    return S.Stream(_live(s, d, name), Fraction(delta), 1, 0, batch.end)


def _replayed(s, *streams: S.Stream, batches: int = 3) -> list[S.Stream]:
    """The streams as live ones, recorded in batches over the time of the first one."""
    root, seconds = f"{readers.shared_folder(s)}/replayed-{uuid.uuid4().hex}", streams[0].end * streams[0].delta / batches
    for i, x in enumerate(streams):
        live.record(x, f"{root}/{i}", seconds, batches)
    return [live.replayed(s, f"{root}/{i}", x, x.end) for i, x in enumerate(streams)]


def _mixed(s, d):
    return S.interleave(_live_stream(s, d, "events", "1/10"), _live_stream(s, d, "orders", "1/5"))


query("stream_interleave", ORACLES["interleave"])(lambda s, d: live.collected(out(_mixed(s, d), "v")))
query("stream_shift", ORACLES["shift"])(lambda s, d: live.collected(out(S.shift(_live_stream(s, d, "events", "1/10"), 7), "v")))
query("stream_decimate", ORACLES["decimate"])(lambda s, d: live.collected(out(S.decimate(_live_stream(s, d, "events", "1/10"), "7/30"), "v")))
query("stream_deinterleave", ORACLES["deinterleave_left"])(lambda s, d: live.collected(out(S.left_of(_mixed(s, d), "1/5"), "v")))
query("stream_deinterleave_right", ORACLES["deinterleave_right"])(lambda s, d: live.collected(out(S.right_of(_mixed(s, d), "1/10"), "v")))
query("stream_window_avg", f"WITH {EV}, w AS (SELECT n, {WIN('sum', 30, 's')} FROM ev) SELECT n, (s // 30)::BIGINT AS f0 FROM w WHERE n >= 29")(lambda s, d: live.collected(live.window_reduce(_live_stream(s, d, "events", "1/360"), 1, 30, "avg").trimmed()))
query("stream_window_step", ORACLES["window_step"])(lambda s, d: live.collected(out(live.window_reduce(_replayed(s, ev(s, d))[0], 3, 7, "sumc", "max"), "s", "m")))
query("stream_fir", ORACLES["fir"])(lambda s, d: live.collected(out(live.fir(_live_stream(s, d, "events", "1/1000"), TAPS26, (len(TAPS26), 1000)), "y")))
query("stream_qrs", ORACLES["qrs_features"])(lambda s, d: live.collected(live.qrs_features(_replayed(s, ev(s, d, "1/360"))[0], TAPS25)))
query("stream_add_static", f"WITH {EV}, {OD} SELECT ev.n, ev.v AS a, od.v AS b FROM ev JOIN od USING (n)")(lambda s, d: live.collected(_live(s, d).withColumnRenamed("f0", "a").join(od(s, d).df.withColumnRenamed("f0", "b"), "n")))
query("stream_add", f"WITH {EV}, {OD} SELECT ev.n, ev.v AS f0, od.v AS f1 FROM ev JOIN od USING (n)")(lambda s, d: live.collected(live.add(_live_stream(s, d, "events", "1/360"), _live_stream(s, d, "orders", "1/360")).trimmed()))
query("stream_add_rate", ORACLES["add_rate"])(lambda s, d: live.collected(out(live.add(*_replayed(s, ev(s, d), pt(s, d))), "a", "b")))


@query("stream_multirate", ORACLES["multirate"])
def _stream_multirate(s, d):
    """A window over the interleave of two shifted live streams; its watermark waits as long as their records may be out of order."""
    a, b = _replayed(s, ev(s, d), od(s, d))
    return live.collected(out(live.window_reduce(S.interleave(S.shift(a, 2), S.shift(b, 1)), 1, 30, "avg"), "v"))


@query("stream_subscribe", f"WITH {EV} SELECT n, v AS f0 FROM ev")
def _subscribe(s, d):
    root, df = f"{readers.shared_folder(s)}/subscribed-{uuid.uuid4().hex}", _live(s, d)
    subscription.publish(df, root).awaitTermination()
    return subscription.Reader(s, root, "all", df.schema).take()


@query("stream_subscribers", f"WITH {EV} SELECT 'all' AS reader, n, v AS f0 FROM ev UNION ALL SELECT 'half', n, v FROM ev WHERE n < {size('ev')} // 2 UNION ALL SELECT 'rest', n, v FROM ev WHERE n >= {size('ev')} // 3")
def _subscribers(s, d):
    """Three readers of one log of batches: one takes all of it, one the first half in two steps, one what is left after a third."""
    x = ev(s, d)
    df, root = _replayed(s, x)[0].df, f"{readers.shared_folder(s)}/subscribed-{uuid.uuid4().hex}"
    subscription.publish(df, root).awaitTermination()
    of = lambda name: subscription.Reader(s, root, name, df.schema)
    of("rest").take(x.end // 3)
    takes = [("all", of("all").take()), ("half", of("half").take(x.end // 4)), ("half", of("half").take(x.end // 2 - x.end // 4)), ("rest", of("rest").take())]
    return pipelines.union([t.select(F.lit(name).alias("reader"), "n", "f0") for name, t in takes])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["qrs_features"](spark, sf_dir)


from tactus.plans import extended  # noqa: E402, F401  registers more queries
