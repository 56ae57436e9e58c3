"""Connected components by alternating stars; every round is a shuffle of the edges and is written to the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that a task contracts at a time before the first round.
CHUNK = 200_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components, fewer: chunks of each partition as stars around their least node."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, r) for x in parent if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > CHUNK:
                yield stars()
        yield stars()

    return edges.mapInArrow(run, "u long, v long")


def settled(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself: edges are stars around the least node of each component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node in edges (two long columns); a component's id is its least node."""
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    now = stored(contracted(edges).distinct(), "stars")
    while not settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "stars")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
