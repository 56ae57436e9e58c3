"""Secret scans: fixed patterns, and a battery of randomness tests on the other long tokens.

A candidate is a run of `[A-Za-z0-9+/_-]` of LEAST characters or more, with up to two `=` of padding, outside the patterns'
finds; so the value after `NAME=` is one of its own. Where the whole run isn't random, its parts between `+`, `/`, `_` and `-`
of LEAST characters or more are candidates. An encoding is inferred from the symbols (the smallest alphabet that holds them; symbols
of one class only, such as words of small letters, have none). Under the hypothesis that the symbols are random in it, four tests
give p-values: chi-squared for uniform use of the alphabet's classes and of its symbols, a runs test of the classes'
alternation, and a serial correlation of neighbouring symbols; Fisher's method combines them. Below REJECTED a candidate isn't
random: one in a hundred random keys is lost so.

Discoveries are secrets, so their hypothesis to reject is that a candidate is an ordinary token. Ordinary tokens follow a Markov
chain of characters, counted over all words of the corpus below LEAST characters on top of a weak prior; a candidate's p-value is
the normal tail of its surprise under the chain, and 1 if the battery rejects its randomness. In each band of lengths, where tests
of like power compete, Benjamini and Hochberg's procedure over the whole corpus reports candidates at a false-discovery rate of
RATE. p-values are kept in steps of 0.01 decades, so that the corpus is summarised by a small histogram.

Defined results: a null text is empty and has no spans; rows that share a doc_id are scanned one by one; a text of any length is
scanned whole; equal candidates get equal verdicts; an empty table gives an empty result; other columns are ignored. Spans are in
code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, short_batches, stored, table, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 20
LONG = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
PART = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST)
RATE, REJECTED = 0.05, 0.01
STEPS, MOST = 100, 3000
SPANS = "array<struct<kind:int,start:int,end:int,band:int,bin:int>>"


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' finds."""
    out = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, after Wilson and Hilferty."""
    return normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings: name, its classes of symbols in the order of their values.
CLASSES = {
    "hex": (DIGITS, "abcdef"),
    "HEX": (DIGITS, "ABCDEF"),
    "base32": (UPPER, "234567"),
    "lower36": (DIGITS, LOWER),
    "upper36": (DIGITS, UPPER),
    "base62": (UPPER, LOWER, DIGITS),
    "base64": (UPPER, LOWER, DIGITS, "+/"),
    "base64url": (UPPER, LOWER, DIGITS, "-_"),
}
#: The symbols of the chain; OTHER stands for all else, word edges included.
SYMBOLS = UPPER + LOWER + DIGITS + "+/_-"
OTHER = len(SYMBOLS)
CODES = np.full(256, OTHER, np.uint8)
CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(OTHER)
#: Weight of the prior in each row of the chain, and what correlation between a token's characters may add to the variance.
PRIOR, SPREAD = 200, 2


def encoding(s: str) -> str | None:
    """The smallest alphabet that holds s, if two of digits, small and capital letters are in s."""
    if sum(re.search(x, s) is not None for x in ("[0-9]", "[a-z]", "[A-Z]")) < 2:
        return None
    return next((k for k, parts in CLASSES.items() if not set(s) - set("".join(parts))), None)


def count_tail(x: float, mean: float) -> float:
    """Upper tail of a Poisson count, half of x's own probability included."""
    if mean > 100:
        return normal_tail((x - mean) / math.sqrt(mean))
    term, below = math.exp(-mean), 0.0
    for k in range(int(x)):
        below += term
        term *= mean / (k + 1)
    return max(1e-300, 1 - below - term / 2)


def randomness(s: str) -> float | None:
    """Combined p-value of s under the hypothesis that it is random in its encoding; None without an encoding."""
    s = s.rstrip("=")
    kind = encoding(s)
    if kind is None:
        return None
    parts = CLASSES[kind]
    size, n = sum(map(len, parts)), len(s)
    where = {c: i for i, p in enumerate(parts) for c in p}
    value = {c: i for i, c in enumerate("".join(parts))}
    cls = [where[c] for c in s]
    share = [len(p) / size for p in parts]
    # Classes: chi-squared.
    chi = sum((cls.count(i) - n * q) ** 2 / (n * q) for i, q in enumerate(share))
    p1 = chi_tail(chi, len(parts) - 1)
    # Symbols: chi-squared is linear in the number of equal pairs, which is nearly a Poisson count.
    equal = sum(k * (k - 1) // 2 for k in Counter(s).values())
    p2 = count_tail(equal, n * (n - 1) / 2 / size)
    # Runs of one class.
    change = 1 - sum(q * q for q in share)
    runs = sum(a != b for a, b in zip(cls, cls[1:], strict=False))
    third = sum(q**3 for q in share)
    keep = 1 - change
    var = (n - 1) * change * keep + 2 * (n - 2) * (third - keep * keep)
    p3 = math.erfc(abs(runs - (n - 1) * change) / math.sqrt(2 * max(var, 1e-9)))
    # Neighbouring values.
    v = [value[c] / (size - 1) - 0.5 for c in s]
    m = sum(v) / n
    ss = sum((x - m) ** 2 for x in v)
    r = sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False)) / ss if ss else 1.0
    p4 = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    stat = -2 * sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3, p4))
    return chi_tail(stat, 8)


@dataclass(frozen=True)
class OrdinaryTokens:
    """A Markov chain of the characters of ordinary tokens."""

    bits: np.ndarray  # surprise of a symbol after another
    mean: float
    variance: float

    @classmethod
    def of(cls, counts: np.ndarray) -> OrdinaryTokens:
        """counts: (OTHER + 1)^2 numbers of pairs of symbols. The prior stays in a class nine times in ten."""
        kind = np.searchsorted([26, 52, 62, OTHER], np.arange(OTHER), side="right")
        sizes = np.bincount(kind)
        same = kind[:, None] == kind[None, :]
        prior = np.where(same, 0.9 / sizes[kind], 0.1 / (OTHER - sizes[kind])[:, None])
        prior = np.vstack([prior, np.full((1, OTHER), 1 / OTHER)])
        c = counts.reshape(OTHER + 1, OTHER + 1)[:, :OTHER].astype(float) + PRIOR * prior
        p = c / c.sum(axis=1, keepdims=True)
        bits = -np.log2(p)
        w = c[:OTHER] / c[:OTHER].sum()
        mean = float((w * bits[:OTHER]).sum())
        return cls(bits, mean, float((w * (bits[:OTHER] - mean) ** 2).sum()))

    def p_value(self, s: str) -> float:
        """How likely an ordinary token of this length is as surprising."""
        x = CODES[np.frombuffer(s.rstrip("=").encode(), np.uint8)].astype(np.int64)
        n = len(x) - 1
        return normal_tail((self.bits[x[:-1], x[1:]].sum() - n * self.mean) / math.sqrt(SPREAD * n * self.variance))


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """Numbers of pairs of symbols in all words below LEAST characters."""
    x = CODES[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    edges = np.flatnonzero(x == OTHER)
    for i in np.flatnonzero(np.diff(edges) > LEAST).tolist():
        x[edges[i] : edges[i + 1]] = OTHER
    return np.bincount(x[:-1].astype(np.int64) * (OTHER + 1) + x[1:], minlength=(OTHER + 1) ** 2)


def ordinary_tokens(docs: DataFrame) -> OrdinaryTokens:
    """The chain of all documents: one aggregate, of which (OTHER + 1)^2 rows at most come to the driver."""

    def run(batches):
        total = np.zeros((OTHER + 1) ** 2, np.int64)
        for batch in batches:
            total += pair_counts(batch.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    short_batches(docs.sparkSession)
    found = texts(docs).select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((OTHER + 1) ** 2)
    counts[[r.pair for r in found]] = [r.n for r in found]
    return OrdinaryTokens.of(counts)


def random_spans(text: str, taken: list[tuple[int, int, int]], model: OrdinaryTokens) -> list[tuple[int, int, int, int]]:
    """(start, end, band of lengths, bin of -log10 p) of candidates that no other span touches."""
    out = []
    for m in LONG.finditer(text):
        a, b = m.span()
        if any(a < e and s < b for s, _, e in taken):
            continue
        whole = [(a, b, randomness(m[0]))]
        parts = [(x.start(), x.end(), randomness(x[0])) for x in PART.finditer(text, a, b)] if not (whole[0][2] or 0) >= REJECTED else []
        for a, b, p in parts if any(p is not None and p >= REJECTED for _, _, p in parts) else whole:
            if p is not None:
                p = model.p_value(text[a:b]) if p >= REJECTED else 1.0
                out.append((a, b, min(7, (b - a).bit_length() - 4), min(MOST, int(-STEPS * math.log10(max(p, 1e-300))))))
    return out


def scan(docs: DataFrame, model: OrdinaryTokens) -> DataFrame:
    """doc_id and every span, candidates included, per document."""

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            found = []
            for raw in batch.column("text").to_pylist():
                text = raw.decode("utf-8", "replace")
                base = base_spans(text, raw)
                row = [{"kind": k, "start": a, "end": b, "band": None, "bin": None} for a, k, b in base]
                row += [{"kind": 3, "start": a, "end": b, "band": w, "bin": p} for a, b, w, p in random_spans(text, base, model)]
                found.append(row)
            kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "end", "band", "bin")]))
            return {"doc_id": batch.column("doc_id"), "found": pa.array(found, kind)}

        return each

    return in_batches(texts(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), f"doc_id long, found {SPANS}", start)


def limits(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each band of lengths, the least bin that is reported. Eight rows at most come to the driver."""
    c = scanned.select(F.explode("found").alias("x")).where("x.kind = 3").groupBy("x.band", "x.bin").agg(F.count("*").alias("n"))
    # A window per band over its histogram, at most MOST rows; the least p-values come first.
    w = Window.partitionBy("band")
    c = c.withColumns({"upto": F.sum("n").over(w.orderBy(F.desc("bin"))), "all": F.sum("n").over(w)})
    hit = F.pow(F.lit(10.0), -F.col("bin") / STEPS) <= rate * F.col("upto") / F.col("all")
    return {r.band: r.least for r in c.groupBy("band").agg(F.min(F.when(hit, F.col("bin"))).alias("least")).collect() if r.least is not None}


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id and its spans: the patterns', and candidates that are discovered as secrets."""
    scanned = stored(scan(docs, ordinary_tokens(docs)), "secret-spans")
    reported = " or ".join(f"(x.band = {b} and x.bin >= {k})" for b, k in limits(scanned, rate).items()) or "false"
    return scanned.select("doc_id", F.expr(f"array_sort(transform(filter(found, x -> x.kind < 3 or ({reported})), x -> struct(x.start, x.kind, x.end)))").alias("spans"))


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) as long)")
    s = s.withColumn("base", F.expr("filter(spans, x -> x.kind < 3)"))
    return s.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with every span replaced by a mark; n_chars follows the text.

    None is dropped: null texts stay null, null and repeated doc_ids don't matter, and columns keep their names, whatever they are.
    """
    model = ordinary_tokens(docs)
    least = limits(stored(scan(docs, model), "secret-spans"))
    names = [f.name for f in docs.schema]

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text, text.encode("utf-8", "replace"))
        spans = sorted([(a, b) for a, _, b in base] + [(a, b) for a, b, w, p in random_spans(text, base, model) if p >= least.get(w, MOST + 1)])
        parts, at = [], 0
        for a, b in spans:
            if a >= at:
                parts += [text[at:a], "[secret]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches):
        for batch in batches:
            out = [masked(t) for t in batch.column("text").to_pylist()]
            cols = {n: batch.column(n) for n in names} | {"text": pa.array(out, batch.schema.field("text").type)}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    short_batches(spark)
    return docs.mapInArrow(run, docs.schema)
