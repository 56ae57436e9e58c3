"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, components.

k-means on a bounded sample gives unit centroids; every vector goes to the cell of its nearest one. Two vectors at cosine t
or more can lie in different cells only near the border: y of cell c can have such a partner in cell d only if
y . (c - d) <= sin(acos t) * |c - d|. So each vector also visits the lower-numbered cells for which that holds, and no pair
is missed. Equal vectors are one node with a multiplicity and a number of its own. Cells are cut into blocks, and a task multiplies
two blocks; it returns link counts and a star per component of the block pair, never the pairs. Up to MOST_CELLS * PER_CELL
vectors, cells keep their size as the input grows; beyond that they grow with it.

Defined results: vectors that are null, zero, empty or hold null or non-finite components have no links and are components of
their own, as are vectors of a length that few share with others (cosines need equal lengths). Rows that share a vec_id are
vectors of their own in the counts and one node of the components. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, stored, table
from .components import components

COSINE = 0.95
#: k-means is fitted on this many vectors at most, those with the least hashes.
SAMPLE = 32_768
#: Vectors aimed at in a cell, and the most cells (the centroids are sent to all tasks: at most this many vectors).
PER_CELL, MOST_CELLS = 1_024, 8_192
BLOCK = 2_048
#: How far below COSINE a single-precision product of unit vectors still counts as near it, and what each dimension adds.
NEAR, NEAR_DIMENSION = 1e-4, 2.0**-22
#: Rows of a product with all centroids.
ROWS = 2_048
ROUNDS = 8


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit vectors; starts from evenly spaced rows, an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + ROWS] @ c.T).argmax(axis=1) for i in range(0, len(x), ROWS)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def distances(c: np.ndarray) -> np.ndarray:
    """Between all centroids, in single precision and not below the truth."""
    out = np.empty((len(c), len(c)), np.float32)
    for i in range(0, len(c), ROWS):
        out[i : i + ROWS] = np.sqrt(np.maximum(0, 2 - 2 * (c[i : i + ROWS] @ c.T)) + 1e-12)
    return np.nextafter(out, np.float32(3), out)


def cells_of(x: np.ndarray, c: np.ndarray, apart: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each row, rows of visits, cells of visits). apart: the centroids' ``distances``."""
    dots = x @ c.T
    home = dots.argmax(axis=1)
    reach = math.sqrt(1 - cosine * cosine) + 1e-9
    near = dots[np.arange(len(x)), home][:, None] - dots <= reach * apart[home] + 1e-9
    near &= np.arange(len(c))[None, :] < home[:, None]
    rows, cells = np.nonzero(near)
    return home, rows, cells


def roots(mask: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id reachable from each row of a symmetric link matrix."""
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(mask, label[None, :], big).min(axis=1, initial=big))
        if (new == label).all():
            return label
        label = new


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each pair of rows has the cosine, in doubles; single products, whose error is far below NEAR, rule the rest out."""
    near = x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(COSINE - NEAR - NEAR_DIMENSION * x.shape[1])
    i, j = np.nonzero(near)
    if len(i) * 8 > near.size:
        return x @ y.T >= COSINE
    for at in range(0, len(i), 100_000):
        part = slice(at, at + 100_000)
        near[i[part], j[part]] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= COSINE
    return near


def block_links(t: pa.Table, kind: type = np.float64) -> pa.Table:
    """(node, n_links, root) of the nodes in one pair of blocks."""
    ids, weight, right = t["node"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy() == 1
    v = pa.concat_arrays(t["v"].chunks)
    ends = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
    x = unit(np.frombuffer(v.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(ids), -1))
    # Two blocks: links within either are another task's.
    a, b = (np.flatnonzero(~right), np.flatnonzero(right)) if right.any() else (np.arange(len(ids)), np.arange(len(ids)))
    mask = linked(x[a], x[b])
    if not right.any():
        np.fill_diagonal(mask, False)
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    mask = mask[np.ix_(rows, cols)]
    if not right.any():
        return pa.table({"node": ids[rows], "n_links": (mask @ weight[rows]).astype(np.int64), "root": roots(mask, ids[rows])})
    few = np.append(a[rows], b[cols])
    both = np.zeros((len(few), len(few)), bool)
    both[: len(rows), len(rows) :] = mask
    both |= both.T
    return pa.table({"node": ids[few], "n_links": (both @ weight[few]).astype(np.int64), "root": roots(both, ids[few])})


def embedding_links(vectors: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = "e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    # Joins and groups by vector go by its hash first, which sorts faster.
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False))).withColumn("h", F.xxhash64("e"))
    nodes = stored(rows.where("sound").groupBy("h", "e").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("node"), "h", "e", "first", "n", F.size("e").alias("dim")), "embedding-nodes")  # stored, so the numbers stay
    links = None
    for dim, count in [tuple(r) for r in nodes.groupBy("dim").count().collect()]:  # a row per vector length
        part = _links_of_length(nodes.where(F.col("dim") == dim), count, per_cell, np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64)
        links = part if links is None else links.unionByName(part)
    if links is None:
        links = spark.createDataFrame([], "node long, n_links long, root long")
    links = stored(links, "embedding-links")
    label = components(links.select("node", "root")).withColumnRenamed("id", "node")
    per_node = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = nodes.join(per_node, "node", "left").join(label, "node", "left").select("node", "h", "e", "first", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "node").alias("group"))
    least = known.groupBy("group").agg(F.min("first").alias("least"))
    known = known.join(least, "group").select("h", "e", "least", (F.col("n_links") + F.col("n") - 1).alias("n_links"))
    found = rows.where("sound").join(known, ["h", "e"]).select("vec_id", "n_links", F.col("least").alias("component_id"))
    out = found.unionByName(rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of_length(nodes: DataFrame, count: int, per_cell: int, kind: type) -> DataFrame:
    rows = nodes
    # Only hashes in the range that the sample's should lie in, six deviations more: the partitions together send little more than the sample.
    share = (SAMPLE + 6 * math.sqrt(SAMPLE)) / count
    if share < 1:
        rows = rows.where(F.col("h") < int(share * 2**64) - 2**63)
    sample = rows.orderBy("h", "node").limit(SAMPLE).select("e").collect()  # bounded by SAMPLE
    k = max(1, min(MOST_CELLS, count // per_cell, len(sample) // 4))
    centroids = spherical_kmeans(unit(np.array([r.e for r in sample])), k)

    def start():
        apart = distances(centroids)  # once a task

        def each(batch: pa.RecordBatch) -> dict:
            given = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = unit(given)
            home, who, where = cells_of(x, centroids, apart)
            at = np.append(np.arange(len(x)), who)
            raw = pa.array([v.tobytes() for v in given.astype(kind)], pa.binary())
            return {"cell": np.append(home, where).astype(np.int64), "home": np.append(np.ones(len(x), bool), np.zeros(len(who), bool)), "node": batch.column("node").to_numpy()[at], "n": batch.column("n").to_numpy()[at], "v": raw.take(pa.array(at))}

        return each

    placed = stored(in_batches(nodes.select("node", "e", "n"), "cell long, home boolean, node long, n long, v binary", start), "embedding-cells")
    size = placed.groupBy("cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("guests")).where("homes > 0")
    p = placed.join(size, "cell")
    # Blocks of a cell: 0 .. homes - 1, then those of guests. A task has a block of homes on the left and any later one, or none, on the right.
    own = F.when(F.col("home"), F.pmod("node", "homes")).otherwise(F.col("homes") + F.pmod("node", F.greatest("guests", F.lit(1)))).cast("int")
    p = p.withColumn("own", own)
    left = F.transform(F.sequence(F.col("own"), F.col("homes") + F.col("guests") - 1), lambda j: F.struct(F.col("own").alias("a"), j.alias("b"), F.lit(0).alias("side")))
    before = F.when(F.least("own", "homes") > 0, F.transform(F.sequence(F.lit(0), F.least("own", "homes") - 1), lambda i: F.struct(i.alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"))))
    p = p.withColumn("pair", F.explode(F.concat(F.when(F.col("home"), left).otherwise(F.array().cast("array<struct<a:int,b:int,side:int>>")), F.coalesce(before, F.array().cast("array<struct<a:int,b:int,side:int>>")))))
    return p.select("cell", "pair.a", "pair.b", "pair.side", "node", "n", "v").groupBy("cell", "a", "b").applyInArrow(lambda t: block_links(t, kind), "node long, n_links long, root long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
