"""Exact removal of repeated passages, with a log-structured fingerprint index.

Fingerprints are winnowed: of the 8-word hashes in a 35-word window the least is the window's anchor, which two equal
windows share at the same place. Consecutive windows with the same anchor form a span, which has the anchor's hash and a hash of
its words: about 7 spans for 100 words, whatever repeats.

Each batch of documents becomes an immutable run: a table of (anchor, span, number), bucketed and sorted by anchor; copies of a
passage are counted before they are shuffled, so a passage that a third of the documents share is a row. A run is merge-joined
with the history on its buckets, without a shuffle: an anchor that occurs once anywhere proves all its windows unique. Then runs are
compacted into one. The batches' spans stay in the order of the documents; those with repeated anchors are joined to them
and verified on words: spans with equal hashes repeat as a whole; where one anchor has different spans, the windows of one copy of
each are compared by digests of their words. Only documents that lose words are shuffled.

Defined results: a null text has no words; a text with fewer words than a window loses none, and one of any length is read whole;
null doc_ids are rows like others; rows are told apart by doc_id and text, and two equal rows repeat each other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Marked, compressed, filtered, in_batches, marks, scratch, stored, table, text_bytes, texts

WINDOW = 35
GRAM = 8
BATCHES = 2
#: Runs that may stand side by side.
MOST_RUNS = 1
NO_ID = -(2**63)
FINGERPRINTS = "h long, span long, doc_id long, row int, lo int, hi int"
#: Bytes of text whose fingerprints make a bucket.
BUCKET_BYTES = 64 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` words, a power of two."""
    from xxhash import xxh3_64_intdigest

    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    base, size = 0x9E3779B97F4A7C15, 1
    while size < width:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % 2**64, 2 * size
    return mixed(h)


def spans(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of each run of windows with one anchor."""
    g = gram_hashes(words, gram)
    count = len(words) - window + 1
    anchor = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(count)
    last = np.append(np.flatnonzero(np.diff(anchor)), count - 1)
    first = np.append(0, last[:-1] + 1)
    return g[anchor[last]], first, last


def word_ends(words: list[bytes]) -> np.ndarray:
    """Where each word begins in the words joined by a space; one more entry at the end."""
    return np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    def start():
        from xxhash import xxh3_64_intdigest

        def each(batch: pa.RecordBatch) -> dict | None:
            out: list[list] = [[] for _ in range(5)]
            spanned: list[int] = []
            for d, r, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                words = text.split()
                if len(words) < WINDOW:
                    continue
                h, lo, hi = spans(words)
                joined, at = b" ".join(words), word_ends(words)
                spanned += [xxh3_64_intdigest(joined[a:b]) for a, b in zip(at[lo].tolist(), (at[hi + WINDOW] - 1).tolist(), strict=True)]
                for o, x in zip(out, (h.view(np.int64), np.full(len(h), d), np.full(len(h), r), lo, hi), strict=True):
                    o.append(x)
            if not spanned:
                return None
            h, d, r, lo, hi = (np.concatenate(x) for x in out)
            return {"h": h, "span": np.array(spanned, np.uint64).view(np.int64), "doc_id": d.astype(np.int64), "row": r.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}

        return each

    return in_batches(docs, FINGERPRINTS, start)


class FingerprintIndex:
    """Immutable runs of (h, span, n), each a table bucketed and sorted by anchor hash h in the shared folder; and the spans of all documents."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.runs, self.spans, self.found = spark, [], [], []
        self.names: list[str] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, rows: DataFrame) -> DataFrame:
        self.names.append(f"run_{uuid.uuid4().hex}")
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", scratch(self.spark, "fingerprints")).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of documents as a run, compacts, and returns the batch's spans whose anchor occurs elsewhere in the index."""
        new = stored(fingerprints(batch), "spans")
        run = self.write(new.groupBy("h", "span").agg(F.count("*").alias("n")))
        met = anchors(run)
        for old in self.runs:
            met = both(met, anchors(old), "left")
        self.found.append(stored(repeats(met), "repeated"))
        self.spans.append(new)
        self.runs.append(run)
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return new.join(self.found[-1], "h", "left_semi")

    def repeated(self) -> DataFrame:
        """(h, several): anchors with two rows or more; several, if their spans differ. A merge join of the runs."""
        met = anchors(self.runs[0])
        for run in self.runs[1:]:
            met = both(met, anchors(run), "full")
        return repeats(met)

    def candidates(self) -> DataFrame:
        """Spans of all batches whose anchor is repeated, as the batches' merge joins have found, with ``several``."""
        found = reduce(DataFrame.unionByName, self.found).groupBy("h").agg(F.max("several").alias("several"))
        found = stored(found, "repeated")
        few = marks(found.select(F.col("h").alias("id")))
        return stored(filtered(reduce(DataFrame.unionByName, self.spans), Marked("h", few)).join(found, "h"), "candidates")

    def compact(self) -> None:
        """One run instead of all."""
        rows = reduce(DataFrame.unionByName, self.runs)
        self.runs = [self.write(rows.groupBy("h", "span").agg(F.sum("n").alias("n")))]

    def forget(self) -> None:
        """Takes the runs' names out of the catalogue; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.runs = [], []


def anchors(run: DataFrame) -> DataFrame:
    return run.groupBy("h").agg(F.sum("n").alias("n"), F.min("span").alias("least"), F.max("span").alias("most"))


def both(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    b = b.select("h", *[F.col(c).alias(f"{c}_b") for c in ("n", "least", "most")])
    n = F.coalesce("n", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    return a.hint("merge").join(b, "h", how).select("h", n.alias("n"), F.least("least", "least_b").alias("least"), F.greatest("most", "most_b").alias("most"))


def repeats(met: DataFrame) -> DataFrame:
    return met.where("n > 1").select("h", (F.col("least") != F.col("most")).alias("several"))


def window_digests(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(w, doc_id, row, at, alone): a digest of the words of every window in the given spans."""
    per_doc = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi", "alone")).alias("places"))
    joined = compressed(docs, Marked("doc_id", marks(per_doc.select(F.col("doc_id").alias("id"))))).join(per_doc, ["doc_id", "row"])

    def start():
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def each(batch: pa.RecordBatch) -> dict:
            w, d, r, at, alone = [], [], [], [], []
            for doc, row, z, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "z", "places")), strict=True):
                words = unpack(z).split()
                joined, ends = b" ".join(words), word_ends(words).tolist()
                for p in places:
                    for s in range(p["lo"], p["hi"] + 1):
                        w.append(hashlib.blake2b(joined[ends[s] : ends[s + WINDOW] - 1], digest_size=16).digest())
                        d.append(doc)
                        r.append(row)
                        at.append(s)
                        alone.append(p["alone"])
            return {"w": pa.array(w, pa.binary()), "doc_id": pa.array(d, pa.int64()), "row": pa.array(r, pa.int32()), "at": pa.array(at, pa.int32()), "alone": pa.array(alone, pa.bool_())}

        return each

    return in_batches(joined, "w binary, doc_id long, row int, at int, alone boolean", start)


def remove(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept text; ranges: (doc_id, row, lo, hi) of repeated windows."""
    per_doc = stored(ranges.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("places")), "ranges")
    few = marks(per_doc.select(F.col("doc_id").alias("id")))
    touched = compressed(docs, Marked("doc_id", few)).join(per_doc, ["doc_id", "row"], "left").select("doc_id", "z", "places")

    def start():
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def each(batch: pa.RecordBatch) -> dict:
            whole = "text" in batch.schema.names
            n, gone, digest, kept = [], [], [], []
            given = batch.column("text" if whole else "z").to_pylist()
            for z, places in zip(given, [None] * len(given) if whole else batch.column("places").to_pylist(), strict=True):
                words = (z if whole else unpack(z)).split()
                n.append(len(words))
                if places:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [p["lo"] for p in places], 1)
                    np.add.at(edge, [p["hi"] + WINDOW for p in places], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            return {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())}

        return each

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return in_batches(touched, schema, start).unionByName(in_batches(docs.select("doc_id", "text"), schema, start, Marked("doc_id", few, others=True)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least long, till the end), row (a hash of the text, which tells rows with one doc_id apart) and text."""
    t = texts(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))))
    return t.select("doc_id", F.hash("text").alias("row"), "text")


def substring_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Ingests the documents batch by batch, then removes every word in a window that occurs elsewhere."""
    rows = keyed(docs)
    index = FingerprintIndex(docs.sparkSession, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // BUCKET_BYTES)))
    for b in range(batches):
        index.ingest(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    found = index.candidates()
    index.forget()
    # Stored, so that the join below is of two plain shuffles, whose large keys Spark can split.
    same = stored(found.groupBy("h", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "lo", "hi")).alias("one"), F.max("several").alias("several")), "repeated-spans")
    whole = found.join(same.where("n > 1").select("h", "span"), ["h", "span"], "left_semi").select("doc_id", "row", "lo", "hi")
    windows = window_digests(same.where("several").select("one.*", (F.col("n") == 1).alias("alone")), rows)
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    single = windows.where("alone").join(twice, "w", "left_semi").select("doc_id", "row", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return remove(rows, whole.unionByName(single)).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
