"""Codes of vectors by codebooks of their parts, exact in integers, over Hilbert-sorted blocks with boxes.

Each vector is cut into 8 parts of integers floor(4096 * x). The points of a part are range-sorted by their key on a Hilbert curve and
cut into flat blocks, stored once with their box (least and greatest component) and their sums. In each round the distances between
box and codebook entries leave a shortlist per block: an entry that is farther than another one from every point of the box
wins no point there. A block with one entry left counts by its stored sums, without its points; in the others a small
integer kernel compares the points with the shortlist. Rounds send 8 * 16 sums to the driver, whatever the input.

Defined results: vectors that are null, empty, or hold null or non-finite components are left out, and so are those whose length is no
multiple of 8 or isn't that of the smallest vec_id's vector; components beyond 16,384 count as that, so that errors
fit a long. Of rows with one vec_id the least vector starts the codebook, and each row gets a code of its own; rows without vec_id get codes but
start no codebook, and a table without any vec_id gives an empty result. Fewer than 16 ids give smaller codebooks. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, stored, table
from .packing import hilbert_keys

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Greatest component: errors of vectors of up to 256 components stay below 2 ** 62.
LARGEST = 16_384.0
#: Points of a block, and bits of a Hilbert key, shared among the dimensions of a part.
BLOCK, KEY_BITS = 64, 60
#: Bytes of points in a range of a curve, and groups that a label's rows are dealt to.
RANGE_BYTES, SALTS = 64 << 20, 32


def _whole(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v array<int>): the vectors that can be cut and compared, with a number for each row; stored, so that the numbers stay."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE).cast("int"))
    return stored(vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).withColumn("row", F.monotonically_increasing_id()), "codes-vectors")


def _first(whole: DataFrame) -> list[list[int]]:
    """The vectors of the smallest ids, one per id: at most 16 rows for the driver."""
    ids = [r.vec_id for r in whole.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    if not ids:
        return []
    least = whole.where(F.col("vec_id").isin(ids)).groupBy("vec_id", "v").agg(F.count("*").alias("n")).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = {r.vec_id: r.v for r in least.collect()}
    size = len(rows[ids[0]])
    return [rows[i] for i in ids if len(rows[i]) == size]


def _boxed(whole: DataFrame, dims: int) -> DataFrame:
    """Hilbert-sorted flat blocks of the vectors' parts: part, lo, hi, total, n, rows and points as arrays' bytes."""
    component = [F.get("v", F.lit(i)) for i in range(PARTS * dims)]
    ends = np.array(whole.agg(*[f(c) for f in (F.min, F.max) for c in component]).first(), np.int64).reshape(2, PARTS, dims)
    lo, span = ends[0], ends[1] - ends[0] + 1
    cut = F.posexplode(F.array(*[F.slice("v", p * dims + 1, dims) for p in range(PARTS)])).alias("part", "x")
    points = whole.select("row", cut).select("part", "row", "x")
    used = min(dims, KEY_BITS)
    bits = max(1, min(16, KEY_BITS // used))

    def keyed() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            part, x = batch.column("part").to_numpy(), _matrix(batch.column("x"), dims)
            cell = ((x - lo[part]) << bits) // span[part]
            return {"part": batch.column("part"), "row": batch.column("row"), "key": hilbert_keys(cell[:, :used], bits), "x": pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())}

        return each

    def blocks() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            part, rows = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(-1, dims)
            turns = np.flatnonzero(np.diff(part)) + 1
            cuts = [c for a, b in zip([0, *turns], [*turns, len(part)], strict=True) for c in range(a, b, BLOCK)]
            out: dict[str, list] = {k: [] for k in ("part", "n", "lo", "hi", "total", "rows", "points")}
            for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
                p = x[a:b]
                for k, v in zip(out, (int(part[a]), b - a, p.min(0).tolist(), p.max(0).tolist(), p.sum(0, dtype=np.int64).tolist(), rows[a:b].astype("<i8").tobytes(), p.tobytes()), strict=True):
                    out[k].append(v)
            kinds = {"part": pa.int32(), "n": pa.int64(), "lo": pa.list_(pa.int32()), "hi": pa.list_(pa.int32()), "total": pa.list_(pa.int64())}
            return out | {k: pa.array(out[k], kind) for k, kind in kinds.items()}

        return each

    # Stored, so that sampling the ranges doesn't compute the keys a second time. The row number splits points that tie.
    keys = stored(in_batches(points, "part int, row long, key long, x binary", keyed), "codes-keys")
    parts = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(keys.agg(F.sum(F.octet_length("x") + 24)).first()[0] or 0) // RANGE_BYTES))
    curve = keys.repartitionByRange(parts, "part", "key", "row").sortWithinPartitions("part", "key", "row")
    return stored(in_batches(curve, "part int, n long, lo array<int>, hi array<int>, total array<long>, rows binary, points binary", blocks), "codes-blocks")


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def shortlist(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries): the entries that may be nearest to a point of the block's box, or tie with the nearest.

    Squared distances to two entries differ by a linear function of the point, whose least value over a box takes an end of it in each
    dimension: exact, and tighter than comparing least and greatest distances.
    """
    apart = book[:, None, :] - book[None, :, :]
    most = (np.maximum(apart, 0)[None] * hi[:, None, None, :] + np.minimum(apart, 0)[None] * lo[:, None, None, :]).sum(3)
    norms = (book * book).sum(1)
    return ~(norms[:, None] - norms[None, :] - 2 * most > 0).any(2)


def nearest(x: np.ndarray, book: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of the shortlist, the lowest of those that tie, and its squared distance, for each point."""
    d = x[:, None, :] - book[short][None, :, :]
    d = (d * d).sum(2)
    at = d.argmin(1)
    return short[at], d[np.arange(len(x)), at]


def _round(blocks: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The next codebooks: (parts, entries, dims)."""
    entries = books.shape[1]

    def start() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            lo, hi, total = (_matrix(batch.column(c), dims) for c in ("lo", "hi", "total"))
            sums, counts = np.zeros((PARTS, entries, dims), np.int64), np.zeros((PARTS, entries), np.int64)
            for p in np.unique(part):
                of = np.flatnonzero(part == p)
                may = shortlist(lo[of], hi[of], books[p])
                for i, short in zip(of, map(np.flatnonzero, may), strict=True):
                    if len(short) == 1:
                        sums[p, short[0]] += total[i]
                        counts[p, short[0]] += n[i]
                        continue
                    x = np.frombuffer(batch.column("points")[int(i)].as_py(), "<i4").reshape(-1, dims).astype(np.int64)
                    at, _ = nearest(x, books[p], short)
                    np.add.at(sums[p], at, x)
                    counts[p] += np.bincount(at, minlength=entries)
            p, e = np.nonzero(counts)
            return {"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": counts[p, e], "total": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))}

        return each

    found = in_batches(blocks, "part int, entry int, n long, total array<long>", start)
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(d))).alias(f"t{d}") for d in range(dims)]).collect()  # 128 at most
    out = books.copy()
    for r in rows:
        out[r.part, r.entry] = [r[f"t{d}"] // r.n for d in range(dims)]
    return out


def _assigned(blocks: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """(row, part, entry, distance) of every point."""

    def start() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            out = []
            for p, lo, hi, rows, points in zip(batch.column("part").to_pylist(), *(_matrix(batch.column(c), dims) for c in ("lo", "hi")), batch.column("rows").to_pylist(), batch.column("points").to_pylist(), strict=True):
                x = np.frombuffer(points, "<i4").reshape(-1, dims).astype(np.int64)
                at, d = nearest(x, books[p], np.flatnonzero(shortlist(lo[None], hi[None], books[p])[0]))
                out.append((np.frombuffer(rows, "<i8"), np.full(len(x), p, np.int32), at.astype(np.int32), d))
            return dict(zip(("row", "part", "entry", "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True))

        return each

    return in_batches(blocks, "row long, part int, entry int, distance long", start)


def _labelled(codes: DataFrame) -> DataFrame:
    """Codes with label_error, the error summed over equal labels, nulls together. A label may have many rows, so its sum is dealt to SALTS groups."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x = codes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return x.join(sums.withColumnRenamed("label", "of"), x["label"].eqNullSafe(F.col("of")) & (x["salt"] == sums["salt"])).drop(sums["salt"], "salt", "of")


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, entries array<int>, error, label_error), codebooks: parts * entries * components).

    ``entries`` are the indexes of a vector's parts, in their order.
    """
    whole = _whole(vectors)
    first = _first(whole)
    dims = len(first[0]) // PARTS if first else 1
    books = np.array(first, np.int64).reshape(-1, PARTS, dims).transpose(1, 0, 2) if first else np.zeros((PARTS, 0, 1), np.int64)
    if not first:  # no vector has an id
        return whole.where("false").select("vec_id", "label", F.col("v").alias("entries"), F.col("row").alias("error"), F.col("row").alias("label_error")), books
    whole = whole.where(F.size("v") == PARTS * dims)
    blocks = _boxed(whole, dims)
    for _ in range(ROUNDS):
        books = _round(blocks, books, dims)
    # A row's parts meet by its number; the sort is of eight pairs.
    of = _assigned(blocks, books, dims).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", "entry"))).alias("e"), F.sum("distance").alias("error"))
    codes = stored(of.join(whole.select("row", "vec_id", "label"), "row").select("row", "vec_id", "label", F.col("e.entry").alias("entries"), "error"), "codes-rows")
    return _labelled(codes).select("vec_id", "label", "entries", "error", "label_error"), books


def code_text(entries: Column) -> Column:
    """Two hexadecimal digits for each index."""
    return F.lower(F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), 2, "0")), ""))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", code_text(F.col("entries")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
