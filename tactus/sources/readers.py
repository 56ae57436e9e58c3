"""Sources and sinks of streams and of tables of results."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tactus.operators.streams import Stream

PROBE = "iter LONG, compute_ns LONG, wake_lag_ns LONG, e2e_ns LONG"


def text_records(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Lines of white-space separated values with an index in front (``n value ...``); the word NULL is no value."""
    parts = F.split(F.trim("value"), r"\s+")
    cols = [F.when(F.upper(F.get(parts, i + 1)) != "NULL", F.get(parts, i + 1).cast("long")).alias(f) for i, f in enumerate(fields)]
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, 0).cast("long").alias("n"), *cols)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a local one of its own only where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tactus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def synthetic(spark: SparkSession, count: int, *fields: Column) -> DataFrame:
    """n and fields computed from it."""
    return spark.range(count).select(F.col("id").alias("n"), *[c.alias(f"f{i}") for i, c in enumerate(fields)])


def tagged(spark: SparkSession, count: int, source: int, width: int) -> DataFrame:
    """Values that tell their source, record and field."""
    return synthetic(spark, count, *[F.lit((source + 1) * 1_000_000) + F.expr("id") * 10 + i for i in range(width)])


def read_probe(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A probe file; a wrong header or a malformed row fails, and so does another number of rows than expected."""
    df = spark.read.schema(PROBE).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    if rows is not None and df.count() != rows:
        raise ValueError(f"{path} hasn't {rows} rows")
    return df


def read_commented_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(metadata: key, value; rows) of a CSV file with ``# key=value`` lines before its header."""
    lines = spark.read.text(path)
    meta = lines.where(F.col("value").startswith("#")).select(F.explode(F.split(F.regexp_replace("value", r"^#\s*", ""), r"\s+")).alias("kv")).where("kv like '%=%'").select(F.substring_index("kv", "=", 1).alias("key"), F.substring_index("kv", "=", -1).alias("value"))
    header = ",".join(f.split()[0] for f in schema.split(", "))
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != header) & (F.trim("value") != ""))
    return meta, body.select(F.from_csv("value", schema).alias("r")).select("r.*")


def read_runs(spark: SparkSession, paths: list[str], schema: str, sep: str | None = None) -> DataFrame:
    """Tables of runs from several files, with the file each row is from: CSV, TSV and JSON (an object a line, or one array of objects)
    by the files' names, in one union. Fields that a file lacks are NULL, others of it are left out; ``sep`` replaces the separators of the names.
    """
    kinds: dict[str, list[str]] = {}
    for p in paths:
        end = p.rsplit(".", 1)[-1].lower()
        kinds.setdefault(end if end in ("json", "jsonl", "ndjson", "tsv") else "csv", []).append(p)
    fields = [f.name for f in StructType.fromDDL(schema)]
    out = None
    for kind, files in kinds.items():
        if kind in ("csv", "tsv"):
            split = sep or ("\t" if kind == "tsv" else ",")
            # Columns are found by the header's names, so files of one kind may order them differently and are read by themselves.
            parts = [_by_header(spark, f, schema, split) for f in files]
        else:
            parts = [spark.read.schema(schema).json(files, multiLine=kind == "json").select(*fields, F.input_file_name().alias("file"))]
        for x in parts:
            out = x if out is None else out.unionByName(x)
    return out


def _by_header(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    there = spark.read.csv(path, header=True, sep=sep)
    cols = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in there.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in StructType.fromDDL(schema)]
    return there.select(*cols, F.input_file_name().alias("file"))


def log_counters(lines: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, counter, value, hits) of each counter's pattern per log; hits other than 1 are violations."""
    found = F.array(*[F.struct(F.lit(k).alias("counter"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("all")) for k, p in patterns.items()])
    x = lines.select(key, F.explode(found).alias("x")).select(key, "x.counter", "x.all")
    return x.groupBy(key, "counter").agg(F.max(F.get("all", F.lit(0)).cast("long")).alias("value"), F.sum(F.size("all").cast("long")).alias("hits"))


def schema_problems(df: DataFrame, schema: str) -> dict[str, str]:
    """Column -> what is wrong with it beside a declared schema: missing, unexpected, or of another type; and order, if only that differs."""
    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    have = dict(df.dtypes)
    out = {c: "missing" for c in want if c not in have} | {c: "unexpected" for c in have if c not in want}
    out |= {c: f"{have[c]} instead of {k}" for c, k in want.items() if c in have and have[c] != k}
    return out or ({"*": "order"} if list(want) != list(have) else {})


def validate_table(df: DataFrame, rules: dict[str, str], schema: str | None = None) -> DataFrame:
    """(rule, violations): rows for which a rule isn't true; ``not_empty`` is always checked, ``header`` counts the columns that differ from a schema."""
    problems = schema_problems(df, schema) if schema else {}
    checks = [F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(k) for k, r in rules.items()]
    one = df.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("not_empty"), *checks)
    one = one.withColumn("header", F.lit(len(problems)).cast("long")) if schema else one
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in one.columns])).alias("x")).select("x.*")


def null_index(s: Stream) -> DataFrame:
    """(n, fields): the records with NULL fields, and which."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(i)) for i, f in enumerate(s.fields)]))
    return s.trimmed().select("n", missing.alias("fields")).where(F.size("fields") > 0)


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
