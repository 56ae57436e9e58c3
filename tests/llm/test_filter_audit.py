"""The filter audit beside plain Python, with nulls, ties, repeated rows and empty tables."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from tactus.llm import filter_audit
from tactus.llm.filter_audit import LETTERS, METRICS

LONG = "word " * 40_000
ROWS = [
    (1, "a b c", "en"), (2, "a b c", "en"), (3, "a b c", None), (3, "a b c", None), (None, "a b c", "en"), (4, None, "de"), (5, "", "de"), (5, "x", ""),
    (6, " ".join(f"w{i}" for i in range(120)), "en"), (7, " ".join(f"w{i}" for i in range(120)), "fr"), (8, LONG, "en"), (9, "A" * 50 + " # b", "de"), (10, " é\x1cz \x0bq", "fr"), (-1, LONG, "de"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, None, 1), (3, 1, None), (6, 1, 0), (7, 1, 1), (None, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    fails = []
    for d, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        least = min((e for e, u, _ in rows if (u or "") == t and e is not None), default=None)
        f = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least]
        fails.append((d, lang or "", {c for c, x in zip(LETTERS, f, strict=True) if x}))
    out = {}
    for part in {p for _, p, _ in fails}:
        of = [(d, f) for d, p, f in fails if p == part]
        for order in map("".join, itertools.permutations(LETTERS)):
            for i, c in enumerate(order):
                left = [(d, f) for d, f in of if not f & set(order[:i])]
                gone = [d for d, f in left if c in f]
                out[part, order, i + 1] = [len(left) - len(gone), len(gone), sum(c in f for _, f in of) - len(gone), sum(f == {c} for _, f in of), sum(d in good for d in gone), sum(d in toxic for d in gone)]
    total = {}
    for (p, o, s), v in out.items():
        total[p, o[s - 1]] = total.get((p, o[s - 1]), 0) + v[1]
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.select("*", *[F.lit("clash").alias(c) for c in ("mask", "n", "part", "words", "first", "good")])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = filter_audit.enumerated(filter_audit.cells(docs, marks)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in [*METRICS, "shapley"]) for r in got}, len(got)


def test_audit_equals_brute_force(spark):
    got, rows = audited(spark, ROWS, LABELS)
    assert got == brute(ROWS, LABELS) and rows == len(got) == 4 * 600


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], LABELS) == ({}, 0)
    assert audited(spark, ROWS[:3], [])[0] == brute(ROWS[:3], [])


def test_limit_on_recursion_is_restored(spark):
    had = spark.conf.get(filter_audit.ROW_LIMIT)
    docs = spark.createDataFrame([(i, f"t{i}", f"l{i}") for i in range(4000)], "doc_id long, text string, lang string")
    got = filter_audit.enumerated(filter_audit.cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got.where("step = 5").count() == 4000 * 120 and spark.conf.get(filter_audit.ROW_LIMIT) == had


@pytest.mark.parametrize("size", ["sf0.001"])
def test_audit_of_the_table(spark, size):
    d = f"/root/testdata/{size}"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r[m] for m in [*METRICS, "shapley"]) for r in filter_audit.query(spark, d).collect()}
    assert got == brute(docs, labels)
