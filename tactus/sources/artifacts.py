"""Streams as artifacts: records, an index of what is missing in them, and a typed descriptor, replaced as a whole.

Each save writes a version of its own and, last, its manifest, a folder that counts once Spark has marked it as finished. Until then
readers find the version before, so a save that fails changes nothing. ``vacuum`` removes versions that no manifest in use names.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.operators.quality import runs
from tactus.operators.streams import Stream

HEAD = "version string, num long, den long, width int, origin long, end long, tail long, names array<string>, types array<string>"
#: Indexes of a field in the joint index of all fields, from which runs are taken.
STRIDE = 1 << 42


def null_runs(s: Stream) -> DataFrame:
    """(field, first, length): the runs of records in which a field is missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(i)) for i, f in enumerate(s.fields)]))
    x = s.trimmed().select("n", F.explode(missing).alias("field"))
    # A run ends with its field, as the stream ends before the next field's indexes begin.
    joint = x.select((F.col("field") * F.lit(STRIDE) + F.col("n")).alias("n"))
    return runs(joint, F.lit(True)).select(F.expr(f"cast(first div {STRIDE}L as int)").alias("field"), F.expr(f"first % {STRIDE}L").alias("first"), "length")


def save_stream(s: Stream, path: str) -> str:
    """Saves the stream as the newest version at ``path`` and returns the version's name.

    Records are ordered by ranges of the index, so that a filter on n skips files.
    """
    if s.end > STRIDE:
        raise ValueError("the stream is too long for an index of what is missing")
    spark, version = s.df.sparkSession, uuid.uuid4().hex
    s.df.select("n", *s.fields).repartitionByRange("n").sortWithinPartitions("n").write.parquet(f"{path}/{version}/records")
    stored = replace(s, df=spark.read.parquet(f"{path}/{version}/records"))
    null_runs(stored).repartitionByRange("field", "first").write.parquet(f"{path}/{version}/nulls")
    kinds = dict(s.df.dtypes)
    head = [(version, s.delta.numerator, s.delta.denominator, s.width, s.origin, s.end, s.tail, s.fields, [kinds[f] for f in s.fields])]
    number = max(_manifests(spark, path), default=0) + 1
    spark.createDataFrame(head, HEAD).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={number}")
    return version


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that were written to their end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [int(f.getPath().getParent().getName().partition("=")[2]) for f in (found or [])]


def descriptor(spark: SparkSession, path: str, number: int | None = None):
    """The newest version's descriptor, or that of one manifest."""
    numbers = _manifests(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no finished stream at {path}")
    return spark.read.schema(HEAD).parquet(f"{path}/manifest={number or max(numbers)}").first()


def load_stream(spark: SparkSession, path: str) -> Stream:
    """The newest version, with the types its descriptor names."""
    h = descriptor(spark, path)
    schema = ", ".join(["n bigint", *(f"{f} {k}" for f, k in zip(h.names, h.types, strict=True))])
    return Stream(spark.read.schema(schema).parquet(f"{path}/{h.version}/records"), Fraction(h.num, h.den), h.width, h.origin, h.end, h.tail)


def load_null_runs(spark: SparkSession, path: str) -> DataFrame:
    """The stored index of what is missing, without a look at the records."""
    return spark.read.schema("field int, first long, length long").parquet(f"{path}/{descriptor(spark, path).version}/nulls")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes all but the newest ``keep`` versions, and what failed saves have left; returns the names of what went."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = sorted(_manifests(spark, path))[-keep:]
    used = {descriptor(spark, path, k).version for k in numbers} | {f"manifest={k}" for k in numbers}
    gone = [name for name in (f.getPath().getName() for f in fs.listStatus(root)) if name not in used]
    for name in gone:
        fs.delete(fs_path(f"{path}/{name}"), True)
    return sorted(gone)
