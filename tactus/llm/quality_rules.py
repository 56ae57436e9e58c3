"""Quality rules with adaptive thresholds.

Per document, counts over the whole text; per (lang, source), a mergeable quantile sketch of each metric, a ratio of two
counts; from the sketches, thresholds that follow each group's own distribution: the upper quartile, and SPREAD times its
distance from the median above it. Then a join of documents and thresholds, and a filter: a document is rejected if a count
is over what the threshold gives for its length by more than SURE standard deviations of such a count (at least those of one), so
that short documents aren't judged by a single line or sign.

The sketch is a log-linear histogram: values under 32 have a bin each, larger ones 16 bins per power of two, so a
quantile is off by at most 1/16. Sketches merge by adding bins: a partial aggregate of Spark builds them, and the
sketches of a language or of everything are sums of those of its sources. They are exact in their counts, so reruns agree.

Defined results: a null text is empty (no words, base_failed). Null lang or source are groups of their own. A group
with fewer than ``least`` documents uses its language's sketch, a language with fewer the sketch of all. Null and
repeated doc_ids are rows of their own, each judged by its own text; ties of a metric share a bin; texts of any length are counted
whole. An empty table gives an empty result. Columns other than doc_id, text, lang and source are ignored, and kept by ``stage``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import short_batches, stored, table, unused

#: Metric -> count, what it is a part of, and unit.
METRICS = {"symbols": ("n_symbols", "word_chars", 1000), "upper": ("n_upper", "n_letters", 1000), "dup_lines": ("n_dup_lines", "n_lines", 1000), "stutter": ("n_stutter", "n_words", 1000), "avg_len": ("word_chars", "n_words", 100)}
SPREAD, SURE = 6, 4
LEAST = 200
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_stutter long"

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of ``width`` words that occur twice or more in the text, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    with np.errstate(over="ignore"):
        z = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        h = z[:n].copy()
        for j in range(1, width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + z[j : j + n]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(h, twice)).tolist():
        seen.setdefault(tuple(at[i : i + width].tolist()), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            edge[places] += 1
            edge[np.asarray(places) + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    chars = len(text.decode("utf-8", "replace"))
    return (
        len(words),
        chars - (len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))),
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(full) - len(set(full)),
        repeated_words(words),
        len(full),
        len(text) - len(text.translate(None, _UPPER)),
        len(text) - len(text.translate(None, _LETTERS)),
        sum(map(bytes.__eq__, words, words[1:])),
    )


COUNTS = [x.split()[0] for x in STATS.split(", ")[1:]]


def with_stats(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with the counts of their texts as columns of these names."""
    kept = docs.columns

    def run(batches):
        for batch in batches:
            rows = [text_stats(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            cols = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, cols)], [*kept, *names])

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema, *[StructField(n, LongType()) for n in names]]))


def document_stats(docs: DataFrame) -> DataFrame:
    """One row per document with the counts of STATS, lang and source."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return with_stats(src, COUNTS).select("doc_id", *COUNTS, "lang", "source")


def metric_columns() -> dict[str, Column]:
    return {m: F.expr(f"{unit} * {a} div greatest({b}, 1)") for m, (a, b, unit) in METRICS.items()}


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 20) | (100 * F.col(n_repeat_words) > 30 * F.col(n_words))


def over(limit: str, names: dict[str, str]) -> Column:
    """Whether any count is surely over what the limits (a map by metric) give; names: columns of the counts."""
    tests = []
    for m, (a, b, unit) in METRICS.items():
        most = f"({limit}['{m}'] * greatest({names[b]}, 1))"
        excess = f"({unit} * {names[a]} - {most})"
        tests.append(f"coalesce({excess} > 0 and double({excess}) * double({excess}) > {SURE * SURE * unit}D * double(greatest({most}, {unit})), false)")
    return F.expr(" or ".join(tests))


def sketch_bin(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (shift * 16 + F.floor(v / F.pow(F.lit(2.0), shift))).cast("int")


def bin_top(b: Column) -> Column:
    """The largest value that falls into bin b."""
    shift = F.greatest(F.floor(b / 16) - 1, F.lit(0))
    return ((b - shift * 16 + 1) * F.pow(F.lit(2.0), shift)).cast("long") - 1


def build_sketches(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bin, n): the mergeable sketch of each metric in each group."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), sketch_bin(c).alias("bin")) for m, c in metric_columns().items()])
    return stats.select(*keys, F.explode(pairs).alias("x")).groupBy(*keys, F.col("x.metric").alias("metric"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_docs, t: metric -> threshold). A window here spans the bins of one sketch, a few hundred rows."""
    w = Window.partitionBy(*keys, "metric")
    cum = sketches.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, bin_top(F.col("bin"))))
    q = cum.groupBy(*keys, "metric").agg(at(50).alias("q50"), at(75).alias("q75"), F.max("all").alias("n_docs"))
    limit = F.col("q75") + SPREAD * (F.col("q75") - F.col("q50"))
    return q.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), F.map_from_entries(F.collect_list(F.struct("metric", limit.cast("long").alias("limit")))).alias("t"))


def limits_of(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """(of_lang, of_source, limits): a row per group in the sketch, with its own limits or those of its language or of all."""
    own = thresholds(sketch, ["lang", "source"])
    by_lang = thresholds(merge_sketches(sketch, ["lang"]), ["lang"]).select(F.col("lang").alias("of"), F.col("n_docs").alias("lang_n"), F.col("t").alias("lang_t"))
    # One row: a threshold for each of the five metrics.
    every = thresholds(merge_sketches(sketch, []), []).first()
    all_t = F.create_map(*[F.lit(x) for kv in (every["t"] if every else {m: None for m in METRICS}).items() for x in kv]).cast("map<string,bigint>")
    t = F.when(F.col("n_docs") >= least, F.col("t")).when(F.col("lang_n") >= least, F.col("lang_t")).otherwise(all_t)
    return stored(own.join(by_lang, own.lang.eqNullSafe(F.col("of"))).select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), t.alias("limits")), "quality-limits")


def quality_rules(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """STATS, base_failed, the thresholds used and kept, one row per document."""
    stats = stored(document_stats(docs).withColumn("base_failed", base_failed()), "quality-stats")
    limits = limits_of(stored(build_sketches(stats.where("not base_failed"), ["lang", "source"]), "quality-sketch"), least)
    # A left join by group: the side of the thresholds has a row per group. Groups without one have failed documents only.
    out = stats.join(limits, stats.lang.eqNullSafe(F.col("of_lang")) & stats.source.eqNullSafe(F.col("of_source")), "left")
    return out.select(*stats.columns, "limits", (~F.col("base_failed") & ~over("limits", {c: c for c in COUNTS})).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*cols)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, each judged by its own text. Texts aren't shuffled: counted once for the sketches, once more for the filter."""
    stats = document_stats(docs).where(~base_failed())
    limits = limits_of(stored(build_sketches(stats, ["lang", "source"]), "quality-sketch"))
    names = {c: unused(docs, c) for c in COUNTS}
    of = {c: unused(docs, c) for c in limits.columns}
    rows = with_stats(docs, list(names.values())).where(~base_failed(names["n_words"], names["n_repeat_words"]))
    limits = limits.select(*[F.col(c).alias(n) for c, n in of.items()])
    rows = rows.join(limits, rows["lang"].cast("string").eqNullSafe(F.col(of["of_lang"])) & rows["source"].cast("string").eqNullSafe(F.col(of["of_source"])))
    return rows.where(~over(of["limits"], names)).select(*docs.columns)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, lang, source, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutter
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
m AS (SELECT doc_id, lang, source, base_failed, r.metric, r.u, r.a, greatest(r.b, 1) AS b, r.u * r.a // greatest(r.b, 1) AS v FROM (SELECT *, unnest([
    {'metric': 'symbols', 'u': 1000, 'a': n_symbols, 'b': word_chars}, {'metric': 'upper', 'u': 1000, 'a': n_upper, 'b': n_letters},
    {'metric': 'dup_lines', 'u': 1000, 'a': n_dup_lines, 'b': n_lines}, {'metric': 'stutter', 'u': 1000, 'a': n_stutter, 'b': n_words},
    {'metric': 'avg_len', 'u': 100, 'a': word_chars, 'b': n_words}]) AS r FROM b)),
f AS (SELECT lang, source, metric, shift, count(*) AS n, v // (1 << shift) AS top FROM
   (SELECT *, greatest(length(bin(v)) - 5, 0)::INTEGER AS shift FROM m WHERE NOT base_failed) GROUP BY ALL),
k AS (SELECT lang, source, metric, ((top + 1) * (1 << shift)) - 1 AS v, n FROM f),
lv AS (SELECT 'own' AS lv, lang, source, metric, v, n FROM k
  UNION ALL SELECT 'lang', lang, NULL, metric, v, sum(n) FROM k GROUP BY ALL
  UNION ALL SELECT 'all', NULL, NULL, metric, v, sum(n) FROM k GROUP BY ALL),
c AS (SELECT lv, lang, source, metric, v, sum(n) OVER (PARTITION BY lv, lang, source, metric ORDER BY v) AS upto,
    sum(n) OVER (PARTITION BY lv, lang, source, metric) AS every FROM lv),
q AS (SELECT lv, lang, source, metric, max(every) AS nd, min(v) FILTER (WHERE upto * 100 >= every * 50) AS q50,
    min(v) FILTER (WHERE upto * 100 >= every * 75) AS q75 FROM c GROUP BY ALL),
t AS (SELECT *, q75 + 6 * (q75 - q50) AS lim FROM q),
x AS (SELECT m.doc_id, m.u, m.a, m.b, CASE WHEN o.nd >= 200 THEN o.lim WHEN l.nd >= 200 THEN l.lim ELSE a.lim END * m.b AS most
  FROM m LEFT JOIN t o ON o.lv = 'own' AND o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source AND o.metric = m.metric
  LEFT JOIN t l ON l.lv = 'lang' AND l.lang IS NOT DISTINCT FROM m.lang AND l.metric = m.metric
  LEFT JOIN t a ON a.lv = 'all' AND a.metric = m.metric),
over AS (SELECT doc_id, bool_or(u * a > most AND (u * a - most)::DOUBLE * (u * a - most)::DOUBLE > 16 * u::DOUBLE * greatest(most, u)::DOUBLE) AS bad
  FROM x GROUP BY doc_id)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(bad, false) AS kept FROM b LEFT JOIN over USING (doc_id)
"""
