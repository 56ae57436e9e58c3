"""Vector codes beside plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.llm import vector_codes
from tactus.llm.vector_codes import ENTRIES, PARTS, ROUNDS

NAN, INF = float("nan"), float("inf")


def brute(rows):
    """[(vec_id, code, error, label_error, digest)] of rows (vec_id, vector, label), all of one length."""
    kept = [(i, [int(np.floor(4096 * max(-16384.0, min(16384.0, float(c))))) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    size = len(kept[0][1]) // PARTS
    start = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        start.setdefault(i, v)
    start = list(start.values())[:ENTRIES]
    books = [[s[p * size : (p + 1) * size] for s in start] for p in range(PARTS)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))

    def assign(v):
        out = []
        for p in range(PARTS):
            d = [far(v[p * size : (p + 1) * size], e) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(ROUNDS):
        of = [assign(v) for _, v, _ in kept]
        for p in range(PARTS):
            for e in range(len(start)):
                x = [v[p * size : (p + 1) * size] for (_, v, _), a in zip(kept, of, strict=True) if a[p][0] == e]
                if x:
                    books[p][e] = [sum(c) // len(x) for c in zip(*x, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    of = [assign(v) for _, v, _ in kept]
    errors = [sum(d for _, d in a) for a in of]
    return sorted(repr((i, "".join(f"{e:02x}" for e, _ in a), err, sum(x for x, (_, _, o) in zip(errors, kept, strict=True) if o == lab), digest)) for (i, _, lab), a, err in zip(kept, of, errors, strict=True))


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit("x").alias(c) for c in ("row", "part", "v", "entries", "error")])
    codes, books = vector_codes.compress(df)
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, vector_codes.books_sha256(books))) for r in codes.withColumn("code", vector_codes.code_text(F.col("entries"))).collect())


def vectors(seed, n, dims, spread=1.0):
    r = random.Random(seed)
    centre = [[r.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(c + r.gauss(0, 0.1))) for c in r.choice(centre)], r.choice([None, 0, 1, 1, 1])) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "dims"), [(1, 300, 16), (2, 40, 64), (3, 700, 8), (4, 5, 24)])
def test_codes_equal_brute_force(spark, seed, n, dims, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    rows = vectors(seed, n, dims)
    random.Random(seed).shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(7, 60, 16)
    odd = [(100, None, 1), (101, [None, *rows[0][1][1:]], 1), (102, [NAN, *rows[0][1][1:]], 0), (103, [INF, *rows[0][1][1:]], 0), (3, rows[9][1], 0), (3, rows[9][1], 0), (None, rows[4][1], None), (-5, [70000.0] * 16, 2), (-6, [-3e38] * 16, 2), (-7, [0.0] * 16, 1)]
    rows += odd + [(200 + i, rows[1][1], 1) for i in range(200)]
    assert got(spark, rows) == brute(rows)
    # Of another length than the smallest id's, or not to be cut into eight: left out.
    assert got(spark, rows + [(1000, [1.0] * 8, 1), (1001, [1.0] * 15, 1), (1002, [], 1)]) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == [] and got(spark, [(None, [1.0] * 8, 1)]) == []


def test_shortlist_keeps_every_winner():
    r = np.random.default_rng(0)
    for _ in range(200):
        book = r.integers(-50, 50, (16, 3))
        x = r.integers(-5, 5, (20, 3)) + r.integers(-50, 50, 3)
        short = np.flatnonzero(vector_codes.shortlist(x.min(0)[None], x.max(0)[None], book)[0])
        every = vector_codes.nearest(x, book, np.arange(16))
        some = vector_codes.nearest(x, book, short)
        assert np.array_equal(every[0], some[0]) and np.array_equal(every[1], some[1])


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in vector_codes.query(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == brute(rows)
