"""Readers and writers on small files, malformed ones included."""

import struct
from fractions import Fraction

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tactus.operators import streams as S
from tactus.sources import artifacts, readers, records
from tactus.streaming import live


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)
    return f"file://{path}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_text_records(spark, tmp_path):
    p = put(tmp_path / "a.txt", "0 5 -7\n1  NULL\t8\n\n2 null 9\n")
    assert rows(readers.text_records(spark, p, ["a", "b"])) == [(0, 5, -7), (1, None, 8), (2, None, 9)]


LINES = {"a.txt": "".join(f"{i * 3} {'NULL' if i % 4 == 0 else i}\n" for i in range(60)), "b.txt": "\n \n7\t8", "c.txt": "", "d.txt": f"{'9' * 18} 1\n\n5 6\n", "_no.txt": "1 1\n"}


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    for name, text in LINES.items():
        put(tmp_path / "in" / name, text)
    want = [(i * 3, None if i % 4 == 0 else i) for i in range(60)] + [(7, 8), (int("9" * 18), 1), (5, 6)]
    for split in (64, 1 << 20):
        got = records.numbered_lines(spark, f"file://{tmp_path}/in", ["a", "b"], split)
        assert rows(got) == sorted([(n, *r) for n, r in enumerate(want)], key=repr)
    assert records.numbered_lines(spark, put(tmp_path / "none.txt", ""), ["a"]).count() == 0


@pytest.mark.parametrize("split", [1, 2, 3, 5, 19, 20, 21])
def test_every_line_is_read_by_one_piece(tmp_path, split):
    for name, text in LINES.items():
        put(tmp_path / name, text)
    r = records.LineReader(f"file://{tmp_path}", split)
    pieces = r.partitions()
    got = [v for p in pieces for b in r.read(p) for v in b.column("value").to_pylist()]
    assert got == [x for name in sorted(LINES) if name[0] != "_" for x in LINES[name].split("\n") if x.strip()]
    assert [p.first for p in pieces] == list(range(len(pieces)))


def test_binary_records(spark, tmp_path):
    data = [(i, -i * i) for i in range(1_000)]
    p = put(tmp_path / "ecg.bin", b"".join(struct.pack("<ii", *r) for r in data))
    for split in (500, 1 << 20):
        got = records.binary_records(spark, p, "<ii", ["MLII", "V1"], split)
        assert rows(got) == sorted([(n, *r) for n, r in enumerate(data)], key=repr) and got.schema.simpleString() == "struct<n:bigint,MLII:bigint,V1:bigint>"
    p = put(tmp_path / "mixed.bin", b"".join(struct.pack("<hd", i, i / 4) for i in range(10)))
    assert rows(records.binary_records(spark, p, "<hd", ["a", "x"])) == sorted([(i, i, i / 4) for i in range(10)], key=repr)
    with pytest.raises(Exception, match="multiple of 8"):
        records.binary_records(spark, put(tmp_path / "cut.bin", b"123456789"), "<ii", ["a", "b"]).count()


def test_records_are_written_in_order(spark, tmp_path):
    df = spark.range(1_000).select((999 - F.col("id")).alias("n"), F.expr("id * 7").alias("a"), F.expr("id / 8").alias("x"))
    path = f"file://{tmp_path}/out"
    for _ in range(2):  # the second replaces the first
        records.write_records(df, path, "<id", ["a", "x"])
        assert rows(records.binary_records(spark, path, "<id", ["a", "x"])) == rows(df)
    records.write_records(spark.createDataFrame([(0, 1, 2.0)], "n long, a long, x double"), path, "<id", ["a", "x"], "append")
    assert records.binary_records(spark, path, "<id", ["a", "x"]).where("n = 1000 and a = 1").count() == 1
    for bad in ("cast(null as bigint)", "1L << 40"):
        with pytest.raises(Exception, match="missing|fit"):
            records.write_records(spark.range(3).selectExpr("id as n", f"{bad.replace('1L << 40', 'shiftleft(1L, 40)')} as a", "0D as x"), path, "<id", ["a", "x"])
    assert records.binary_records(spark, path, "<id", ["a", "x"]).count() == 1_001  # what failed has changed nothing


def test_probe_files(spark, tmp_path):
    head = "iter,compute_ns,wake_lag_ns,e2e_ns\n"
    p = put(tmp_path / "probe.csv", head + "0,10,1,11\n1,12,2,14\n")
    assert rows(readers.read_probe(spark, p, rows=2)) == [(0, 10, 1, 11), (1, 12, 2, 14)]
    with pytest.raises(ValueError):
        readers.read_probe(spark, p, rows=3)
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_probe(spark, put(tmp_path / "order.csv", "iter,wake_lag_ns,compute_ns,e2e_ns\n0,10,1,11\n")).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_probe(spark, put(tmp_path / "bad.csv", head + "0,ten,1,11\n")).collect()


def test_commented_csv(spark, tmp_path):
    p = put(tmp_path / "shadow.csv", "# rate=360 clients=2\n#host=pi\niter,wake_lag_ns\n0,5\n1,-6\n")
    meta, body = readers.read_commented_csv(spark, p, "iter LONG, wake_lag_ns LONG")
    assert rows(meta) == [("clients", "2"), ("host", "pi"), ("rate", "360")] and rows(body) == [(0, 5), (1, -6)]


def test_run_tables_of_several_files(spark, tmp_path):
    a, b = put(tmp_path / "r1/a.tsv", "case\tslots\nw1\t5\n"), put(tmp_path / "r2/b.tsv", "slots\tcase\tmore\n6\tw2\tx\n\tw3\tx\n")
    c, d = put(tmp_path / "r3/c.json", '[{"case": "w4", "slots": 7},\n {"slots": 8, "extra": {"a": 1}}]'), put(tmp_path / "r3/d.jsonl", '{"case": "w5", "slots": 9}\n{"case": "w6"}\n')
    e = put(tmp_path / "e.csv", "case,rate\nw7,1\n")
    got = readers.read_runs(spark, [a, b, c, d, e], "case STRING, slots LONG")
    assert sorted([(r.case, r.slots, r.file.rsplit("/", 1)[1]) for r in got.collect()], key=repr) == sorted([("w1", 5, "a.tsv"), ("w2", 6, "b.tsv"), ("w3", None, "b.tsv"), ("w4", 7, "c.json"), (None, 8, "c.json"), ("w5", 9, "d.jsonl"), ("w6", None, "d.jsonl"), ("w7", None, "e.csv")], key=repr)
    assert [r.slots for r in readers.read_runs(spark, [put(tmp_path / "f.txt", "case;slots\nw;3\n")], "case STRING, slots LONG", sep=";").collect()] == [3]


def test_streams_are_saved_with_their_descriptor(spark, tmp_path):
    df = spark.createDataFrame([(n, None if n % 4 in (2, 3) else n * n, n / 2 if n % 6 else None) for n in range(40)], "n long, f0 long, f1 double")
    s = S.shift(S.Stream(df, Fraction(147, 1000), 2, 0, 40, 3), 2)
    path = f"file://{tmp_path}/s"
    first = artifacts.save_stream(s, path)
    t = artifacts.load_stream(spark, path)
    assert (t.delta, t.width, t.origin, t.end, t.tail) == (s.delta, s.width, s.origin, s.end, s.tail) and rows(t.df) == rows(s.df) and t.df.dtypes == s.df.dtypes
    want = {n + 2: [i for i, v in enumerate((None if n % 4 in (2, 3) else 1, 1 if n % 6 else None)) if v is None] for n in range(40)}
    assert {r.n: r.fields for r in readers.null_index(t).collect()} == {n: f for n, f in want.items() if f}
    runs = artifacts.load_null_runs(spark, path).collect()
    assert sorted((r.field, n) for r in runs for n in range(r.first, r.first + r.length)) == sorted((f, n) for n, fs in want.items() for f in fs)
    assert {r.length for r in runs if r.field == 0} == {2} and {r.length for r in runs if r.field == 1} == {1}
    second = artifacts.save_stream(s.select(F.col("f1")), path)
    assert first != second and artifacts.load_stream(spark, path).width == 1 and artifacts.descriptor(spark, path).types == ["double"]


def test_a_save_that_fails_leaves_the_old_stream(spark, tmp_path, monkeypatch):
    s = S.Stream(spark.range(50).selectExpr("id as n", "id as f0"), Fraction(1), 1, 0, 50)
    path = f"file://{tmp_path}/s"
    version = artifacts.save_stream(s, path)
    for broken in ("null_runs", "_manifests"):
        with monkeypatch.context() as m:
            m.setattr(artifacts, broken, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                artifacts.save_stream(s.select(F.col("f0") + 1), path)
        assert rows(artifacts.load_stream(spark, path).df) == [(n, n) for n in sorted(range(50), key=lambda n: repr((n, n)))]
    put(tmp_path / "s/manifest=9/part-0.parquet", b"not finished")
    assert artifacts.descriptor(spark, path).version == version
    gone = artifacts.vacuum(spark, path)
    assert len(gone) == 3 and "manifest=9" in gone and rows(artifacts.load_stream(spark, path).df) and artifacts.vacuum(spark, path) == []
    with pytest.raises(FileNotFoundError):
        artifacts.load_stream(spark, f"file://{tmp_path}/none")


def test_header_and_types_are_checked(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "study long, family string")
    found = lambda schema, d=df: {r.rule: r.violations for r in readers.validate_table(d, {"known": "study is not null"}, schema).collect()}
    assert found("study LONG, family STRING") == {"not_empty": 0, "known": 1, "header": 0}
    assert readers.schema_problems(df, "study INT, rate LONG") == {"rate": "missing", "family": "unexpected", "study": "bigint instead of int"}
    assert readers.schema_problems(df, "family STRING, study LONG") == {"*": "order"}
    assert found("study LONG, family STRING, more INT", df.where("false")) == {"not_empty": 1, "known": 0, "header": 1}


def test_tagged_sources_tell_where_they_are_from(spark):
    a, b = (S.Stream(readers.tagged(spark, 300, i, 2), Fraction(d), 2, 0, 300) for i, d in ((0, "1/10"), (1, "1/5")))
    for field, place in (("f0", 0), ("f1", 1)):
        got = S.provenance(S.interleave(a, b), field).collect()
        assert all((r.source, r.record, r.place) == ((1, r.n // 3, place) if r.n % 3 == 0 else (0, r.n - r.n // 3 - 1, place)) for r in got) and len(got) > 400


def test_rate_source_is_deterministic(spark, tmp_path):
    q = live.rate_source(spark, 2_000).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/rate").trigger(processingTime="1 second").start()
    try:
        for _ in range(30):
            q.awaitTermination(1)
            if q.lastProgress and q.lastProgress["numInputRows"]:
                break
    finally:
        q.stop()
    got = spark.read.parquet(f"file://{tmp_path}/rate")
    assert got.count() > 0 and got.where(F.col("f0") != F.pmod(F.xxhash64("n"), F.lit(256))).count() == 0


def test_file_index(spark, tmp_path):
    put(tmp_path / "x/a.bin", b"abc")
    r = readers.file_index(spark, f"file://{tmp_path}/x").first()
    assert r.bytes == 3 and r.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
