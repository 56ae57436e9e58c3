"""Audit of filters that overlap: what each removes in every order of application, by a recursive query.

Documents are reduced to cells (part, mask of the filters they fail) with their counts, at most 32 a part. A recursive CTE then
extends prefixes of filters with letters not used yet: each level joins the part's cells, adds the letter's bit to those applied
and emits that step's metrics, which the row carries to the end of its order.

Filters (word: maximal run of ``[^\\x20\\x09-\\x0D]``): A, under 100 words; B, 100 * distinct words < 80 * words; C, 100 * ``[A-Z]``
characters > 10 * code points; D, holds any of ``#$%&*|``; E, the text of a smaller doc_id, table-wide.

Defined results: a null text is empty, and equal to other empty ones; a null lang or an empty one is the part ''; a row without doc_id has
no label and never fails E, nor makes another row fail it; rows of one doc_id with one text fail E together or not at all;
each row counts. A doc_id with several labels is good, or toxic, if any of them says so. Texts are read whole, whatever their
length, and compared by their SHA-256. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LETTERS = "ABCDE"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
#: Metrics of one step; ``applied`` are the bits of the filters before it, ``bit`` is its own.
METRICS = {
    "kept": "if(c.mask & (w.applied | l.bit) = 0, c.n, 0)",
    "removed": "if(c.mask & w.applied = 0 and c.mask & l.bit > 0, c.n, 0)",
    "redundant": "if(c.mask & w.applied > 0 and c.mask & l.bit > 0, c.n, 0)",
    "unique_fails": "if(c.mask = l.bit, c.n, 0)",
    "good_lost": "if(c.mask & w.applied = 0 and c.mask & l.bit > 0, c.good, 0)",
    "toxic_lost": "if(c.mask & w.applied = 0 and c.mask & l.bit > 0, c.toxic, 0)",
}


def fingerprints(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, part, mask, n): rows by text, id and part, with the bits of the filters A to D."""
    x = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    x = x.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), words.alias("words"), F.char_length("text").alias("chars"), F.octet_length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"), F.rlike("text", F.lit(r"[#$%&*|]")).alias("signs"))
    x = x.select("doc_id", "part", "digest", F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("distinct"), "chars", "capitals", "signs")
    fails = ["words < 100", "100L * distinct < 80L * words", "100L * capitals > 10L * chars", "signs"]
    mask = F.expr(" + ".join(f"if({e}, {1 << i}, 0)" for i, e in enumerate(fails)))
    return x.groupBy("digest", "doc_id", "part", mask.alias("mask")).agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows fail exactly the filters of a mask."""
    # Counted by text, id and part first, so that copies are few rows; stored, as it is read twice and texts only once.
    rows = stored(fingerprints(docs), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    x = rows.join(first, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << 4).otherwise(0)
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return x.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def enumerated(of: DataFrame) -> DataFrame:
    """(part, filter_order, step, metrics ..., shapley) of every order of the filters, from their cells."""
    spark = of.sparkSession
    letters = "array(" + ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(LETTERS)) + ")"
    step = ", ".join(f"'{m}', aggregate(k.cells, 0L, (s, c) -> s + {e})" for m, e in METRICS.items())
    empty = f"cast(array() as array<struct<step:int,{','.join(f'{m}:bigint' for m in METRICS)}>>)"
    walk = spark.sql(
        f"""
        WITH RECURSIVE walk AS (
          SELECT part, '' AS filter_order, 0 AS applied, 0 AS step, {empty} AS path FROM {{parts}}
          UNION ALL
          SELECT w.part, concat(w.filter_order, l.letter), w.applied | l.bit, w.step + 1, array_append(w.path, named_struct('step', w.step + 1, {step}))
          FROM (SELECT *, explode(filter({letters}, x -> applied & x.bit = 0)) AS l FROM walk) w JOIN {{parts}} k ON w.part = k.part
        )
        SELECT part, filter_order, inline(path) FROM walk WHERE step = {len(LETTERS)}""",
        parts=stored(of.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "audit-cells"),
    )
    # Each level is a run of its own, so the walk is stored; its rows follow the number of parts, which no limit may cut off.
    limit = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        walk = stored(walk, "audit-walk")
    finally:
        spark.conf.set(ROW_LIMIT, limit) if limit is not None else spark.conf.unset(ROW_LIMIT)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shares = walk.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return walk.withColumn("letter", letter).join(shares, ["part", "letter"]).select("part", "filter_order", "step", *METRICS, "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerated(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_MASK = "(words < 100)::INT + 2 * (100 * different < 80 * words)::INT + 4 * (100 * capitals > 10 * chars)::INT + 8 * signs::INT + 16 * (doc_id > lowest)::INT"
_STEP = {"kept": ("n", "mask & (applied | bit) = 0"), "removed": ("n", "mask & applied = 0 AND mask & bit > 0"), "redundant": ("n", "mask & applied > 0 AND mask & bit > 0"), "unique_fails": ("n", "mask = bit"), "good_lost": ("good", "mask & applied = 0 AND mask & bit > 0"), "toxic_lost": ("toxic", "mask & applied = 0 AND mask & bit > 0")}
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
  f AS (SELECT doc_id, part, len(ws) AS words, len(list_distinct(ws)) AS different, length(text) AS chars, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, regexp_matches(text, '[#$%&*|]') AS signs, min(doc_id) OVER (PARTITION BY text) AS lowest FROM w),
  g AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1),
  m AS (SELECT part, coalesce({_MASK}, 0) AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY 1, 2),
  l AS (SELECT substr('{LETTERS}', i, 1) AS letter, 1 << (i - 1) AS bit FROM (SELECT unnest(range(1, 6))::INT AS i)),
  o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || letter FROM o, l WHERE position(letter IN filter_order) = 0),
  s AS (SELECT filter_order, i AS step, substr(filter_order, i, 1) AS letter FROM o, (SELECT unnest(range(1, 6))::INT AS i) WHERE length(filter_order) = 5),
  t AS (SELECT filter_order, step, s.letter, l.bit, coalesce((SELECT sum(p.bit)::INT FROM l p WHERE position(p.letter IN substr(filter_order, 1, step - 1)) > 0), 0) AS applied FROM s JOIN l ON l.letter = s.letter),
  r AS (SELECT part, filter_order, step, letter, {', '.join(f'coalesce(sum({v}) FILTER (WHERE {c}), 0)::BIGINT AS {k}' for k, (v, c) in _STEP.items())} FROM t, m GROUP BY ALL)
SELECT part, filter_order, step, {', '.join(_STEP)}, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r"""
