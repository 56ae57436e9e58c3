"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow boosted trees on statistics of the text propose rules (each path from a root is a conjunction of thresholds); logistic
regression with an L1 penalty weighs them and drops most; the rest becomes one column expression over the statistics, so
scoring is a projection. Fitting takes a bounded sample of labelled rows, those with the least hashes of their doc_id.

Defined results: a null text is empty and gets the score of its (zero) statistics. Without labels of both kinds every score is
the share of label 1, or 0.5 if there are none. Rows with null labels aren't learnt from; a doc_id with several labels counts
with each. Texts of any length are counted whole; equal texts get equal scores, and rows that share a doc_id have scores of their own.
An empty table gives an empty result. doc_id, lang, source and labels are no inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .quality_rules import document_stats

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, LEAF, RATE = 40, 3, 10, 0.3
PENALTY, STEPS = 0.002, 2_000


def features() -> dict[str, str]:
    """Name -> SQL over the statistics; all are integers."""
    part = lambda a, b, unit=1000: f"({unit} * {a}) div greatest({b}, 1)"
    return {"words": "n_words", "avg_len": part("word_chars", "n_words", 100), "symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "upper": part("n_upper", "n_letters"), "letters": part("n_letters", "word_chars"), "stutter": part("n_stutter", "n_words"), "line_len": part("n_words", "n_lines", 10)}


Rule = tuple[tuple[str, bool, float], ...]  # (feature, above, threshold) and ...


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        names = features()
        z = F.lit(self.base)
        for rule, weight in self.rules:
            hit = F.expr(" and ".join(f"{names[f]} {'>' if above else '<='} {t!r}D" for f, above, t in rule))
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, add: np.ndarray) -> None:
    """One regression tree by exact splits; collects the paths, and adds leaf values to ``add``."""
    best = None
    if depth:
        g, h = residual[rows].sum(), weight[rows].sum()
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            gl, hl = np.cumsum(residual[order])[:-1], np.cumsum(weight[order])[:-1]
            ok = v[:-1] < v[1:]
            ok[: LEAF - 1] = False
            ok[len(ok) - LEAF + 1 :] = False
            if not ok.any():
                continue
            gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), -1)
            i = int(gain.argmax())
            if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                best = (gain[i], f, (v[i] + v[i + 1]) / 2)
    if path:
        out.append(path)
    if best is None:
        add[rows] += RATE * residual[rows].sum() / (weight[rows].sum() + 1)
        return
    _, f, t = best
    above = x[rows, f] > t
    grow(x, residual, weight, rows[above], depth - 1, (*path, (f, True, float(t))), out, add)
    grow(x, residual, weight, rows[~above], depth - 1, (*path, (f, False, float(t))), out, add)


def hits(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    share = y.mean() if len(y) else 0.5
    if share in (0, 1) or not len(y):
        return RuleModel(math.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5)) if len(y) else 0.0, [])
    z = np.full(len(y), math.log(share / (1 - share)))
    paths: list[tuple] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH, (), paths, z)
    rules = list(dict.fromkeys(paths))
    a = np.column_stack([hits(x, r) for r in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    # Proximal gradient with momentum for the L1-penalised logistic loss; the base isn't penalised.
    a1 = np.column_stack([np.ones(len(y)), a])
    step = 4 * len(y) / (np.linalg.norm(a1, 2) ** 2)
    w = v = np.zeros(a1.shape[1])
    k = 1.0
    for _ in range(STEPS):
        g = a1.T @ (1 / (1 + np.exp(-(a1 @ v))) - y) / len(y)
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        k2 = (1 + math.sqrt(1 + 4 * k * k)) / 2
        v = new + (k - 1) / k2 * (new - w)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, k = new, k2
    return RuleModel(float(w[0]), [(tuple((names[f], up, t) for f, up, t in r), float(c)) for r, c in zip(rules, w[1:], strict=True) if c])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    names = list(features())
    rows = stats.join(labels.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").where(F.col("y").isNotNull() & ~held_out())
    rows = rows.withColumn("hash", F.xxhash64("doc_id"))
    # Only hashes in the range that the sample's should lie in, six deviations more: the partitions together send little more than the sample.
    share = (sample + 6 * math.sqrt(sample)) / max(rows.count(), 1)
    if share < 1:
        rows = rows.where(F.col("hash") < int(share * 2**64) - 2**63)
    got = rows.select(*[F.expr(e).cast("double").alias(n) for n, e in features().items()], "y", "hash", "doc_id").orderBy("hash", "doc_id", "y", *names).limit(sample).collect()  # bounded by sample
    data = np.array([[r[n] for n in names] + [r.y] for r in got], float).reshape(len(got), len(names) + 1)
    return fit_rules(data[:, :-1], (data[:, -1] >= 0.5).astype(float), names)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = stored(document_stats(docs).drop("lang", "source"), "classifier-stats")
    score = train(stats, labels, sample).score()
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
