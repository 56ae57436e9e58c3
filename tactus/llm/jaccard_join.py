"""Exact Jaccard similarity join of documents on word shingles, by partitioned pigeonholes.

Sets r and s with Jaccard similarity of 0.8 or more differ in at most H = (|r| + |s|) div 9 elements. Sizes are cut into
bands; the scheme of a band serves pairs whose larger set lies in it. A scheme hashes the universe of shingles into m
segments. If r and s share no segment, each non-empty segment of s holds a difference, so a set with more than H non-empty
segments is *complete*: whatever is similar to it shares one. Sets that aren't complete also index the one-deletion
neighbourhoods of their segments, which count two differences each, and those for which even that is not enough meet in a
key of their own. A pair is missed by none of this. m is allocated per band by the expected number of keys.

A complete set with e more non-empty segments than H shares at least e of them with whatever is similar to it, so each set
leaves out its e - 1 most common keys, in one order for all: the rarest key that two similar sets share is left out by
neither. Passages that many documents share make common keys, so few keys are left that join documents by chance. Before that,
one star per document and a first round of components take near-copy groups out: pairs are only formed across components.
Parity sketches, whose bits bound the differences of two sets from below, drop most of the rest. All
pairs that remain are verified exactly.

Defined results: words `[^ \\t-\\r]+` of the text with A-Z in lower case; fewer words than a shingle has make one shingle of
all; no words, an empty set that links with nothing (a null text too); a text of any length is shingled whole. Rows that share a doc_id are one node: it is linked
with the copies of any of its texts, and with texts that are similar to its least one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Marked, compressed, give_back, in_batches, marks, short_batches, stored, table, text_bytes, texts, unused
from .components import components
from .substring_dedup import mixed

SHINGLE = 5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80
RATIO = 1.4
#: Sizes of sets that may be similar lie in one band of this ratio or in neighbouring ones; more than 100 / PERCENT.
BAND = 1.26
#: Keys to spare beyond H that a scheme aims at, and what each one missing costs in chance pairs.
SPARE, CHANCE = 0.12, 8
#: Keys that a task gathers before it sends them, and rows that a batch has at most.
FLUSH, EMIT = 1_000_000, 100_000
#: Digests of sets that a task remembers, in each of two generations.
SEEN = 500_000
#: Bytes of text whose keys make a part of the key space: some millions of keys, which a task sorts in memory.
PART_BYTES = 64 << 20
BLOBS = ["part", "doc_id", "n_shingles", "digest", "sketch", "blob"]
#: Bits of a set's parity sketch.
SKETCH = 512


def differences(a: int, b: int) -> int:
    """Most elements in which similar sets of these sizes differ."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def _bands() -> list[tuple[int, int]]:
    """(least, largest) set size of each band, up to sizes that no text reaches."""
    out, low = [(1, 4)], 5
    while low < 2**31:
        out.append((low, max(low, int(low * RATIO))))
        low = out[-1][1] + 1
    return out


def _segments(low: int, high: int) -> tuple[int, int]:
    """(m, H) of a band's scheme: m with the least expected cost of keys, of those of incomplete sets and of chance pairs."""
    h = differences(high, high)
    if h == 0:
        return 1, 0
    best = None
    for m in range(h + 1, 2 * h + 4, max(1, h // 60)):
        cost = 0.0
        for n in (low, (low + high) // 2, high):
            empty = m * (1 - 1 / m) ** n
            incomplete = 0.5 * math.erfc((m - h - 0.5 - empty) / (max(0.3, math.sqrt(empty)) * math.sqrt(2)))
            cost += m + incomplete * (n + m) + CHANCE * max(0.0, 1 + SPARE * h - (m - h - empty))
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1], h


BANDS = _bands()
SCHEMES = [_segments(*x) for x in BANDS]


def schemes_of(n: int) -> list[int]:
    """Bands that a set of size n can meet a similar set in: its own and those of larger ones."""
    own = bisect.bisect_left(BANDS, n, key=lambda x: x[1])
    out = [own]
    while PERCENT * BANDS[out[-1] + 1][0] <= 100 * n:
        out.append(out[-1] + 1)
    return out


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    x = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    h = x[:n].copy()
    for j in range(1, SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n]
    return np.unique(mixed(h))


def sketch(tokens: np.ndarray) -> list[int]:
    """Parities of the tokens' hashes in SKETCH cells, as words. Sets differ in at least as many elements as their sketches in bits."""
    return np.packbits((np.bincount((tokens % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64).tolist()


def keys_of(tokens: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each scheme of the set: its keys; the scheme, and by how many keys the set is complete in it (0: it isn't)."""
    out = []
    for b in schemes_of(len(tokens)):
        m, h = SCHEMES[b]
        seg = ((tokens >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        parts = mixed(tokens + np.uint64(b + 1))
        sizes, sums = np.bincount(seg, minlength=m), np.zeros(m, np.uint64)
        np.add.at(sums, seg, parts)
        full = np.flatnonzero(sizes)
        tags = mixed((np.uint64(b) << np.uint64(32)) + np.arange(1, m + 1, dtype=np.uint64))
        keys = [mixed(sums[full] ^ tags[full])]
        spare = len(full) - h
        if spare <= 0:
            deletion = tags ^ np.uint64(0x5851F42D4C957F2D)
            several = sizes[seg] > 1
            keys += [mixed(sums[full] ^ deletion[full]), mixed((sums[seg] - parts)[several] ^ deletion[seg[several]])]
            if np.minimum(sizes, 2).sum() <= h:
                keys.append(mixed(np.array([b], np.uint64) + np.uint64(0xD1342543DE82EF95)))
        out.append((np.concatenate(keys), b << 32 | max(spare, 0)))
    return out


def key_blobs(nodes: DataFrame, parts: int) -> DataFrame:
    """A row per document with its set's summary, and rows that hold many documents' keys of one part of the key space.

    Keys travel as arrays, a few kilobytes a row, so that Spark moves them without handling each one. A document whose set a task
    has seen before sends no keys: it links with its copies by their digest.
    """

    def start():
        seen: list[set[bytes]] = [set(), set()]
        held: dict[str, list] = {"keys": [], "doc_id": [], "spare": [], "count": []}

        def summary(doc_ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            n, digest, sketches = [], [], []
            for d, s in zip(doc_ids, sets, strict=True):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(sketch(s))
                if not len(s) or digest[-1] in seen[0] or digest[-1] in seen[1]:
                    continue
                if len(seen[0]) >= SEEN:
                    seen[:] = [set(), seen[0]]
                seen[0].add(digest[-1])
                for k, spare in keys_of(s):
                    for c, x in zip(("keys", "doc_id", "spare", "count"), (k, d, spare, len(k)), strict=True):
                        held[c].append(x)
            size = len(n)
            part = [d % parts for d in doc_ids]
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.nulls(size, pa.binary())], BLOBS)

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held["keys"])
            entry = np.repeat(np.arange(len(held["count"])), held["count"])
            doc_id, spare = np.array(held["doc_id"], np.int64), np.array(held["spare"], np.int64)
            for x in held.values():
                x.clear()
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            keys, entry = keys[order], entry[order]
            ends = np.cumsum(np.bincount(part, minlength=parts))
            blobs, at = [], []
            for p, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                if a < b:
                    new = np.append(True, entry[a + 1 : b] != entry[a : b - 1])
                    first = np.flatnonzero(new)
                    own = entry[a:b][first]
                    count = np.diff(np.append(first, b - a)).astype("<u4")
                    blobs.append(b"".join((len(own).to_bytes(4, "little"), doc_id[own].tobytes(), spare[own].tobytes(), count.tobytes(), keys[a:b].tobytes())))
                    at.append(p)
            n = len(at)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))), pa.array(blobs, pa.binary())], BLOBS)

        return summary, flush, held

    def run(batches):
        summary, flush, held = start()
        for batch in batches:
            yield summary(batch.column("doc_id").to_pylist(), [shingle_set(t) for t in batch.column("text").to_pylist()])
            if sum(held["count"]) >= FLUSH:
                yield flush()
        if held["count"]:
            yield flush()
        give_back()

    short_batches(nodes.sparkSession)
    return nodes.mapInArrow(run, "part int, doc_id long, n_shingles long, digest binary, sketch array<long>, blob binary")


def met_in(keys: np.ndarray, doc_id: np.ndarray, spare: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, doc_id, spare, first document of the key, whether the key has two documents) of keys with two documents or more."""
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    few = np.flatnonzero(np.append(same, False) | np.append(False, same))
    k, e = k[few], entry[order[few]]
    d = doc_id[e]
    order = np.lexsort((d, k))
    k, e, d = k[order], e[order], d[order]
    # Rows with one doc_id are one document.
    once = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.empty(0, bool)
    k, e, d = k[once], e[once], d[once]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group)[group] if len(k) else group
    first = d[np.flatnonzero(new)][group] if len(k) else d
    keep = size > 1
    return k[keep], d[keep], spare[e][keep], first[keep], size[keep] == 2


def found_in(nodes: DataFrame) -> DataFrame:
    """One pass over the texts and one shuffle; rows of three kinds.

    ``set``: doc_id, n_shingles, digest, sketch of each document. ``vote``: doc_id shares n keys with the document b, the first
    of each of these keys, and nobody else has ``two`` of them. ``key``: doc_id holds a key that three documents or more hold.
    """
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(nodes) // PART_BYTES))
    names = ["kind", "doc_id", "n_shingles", "digest", "sketch", "b", "n", "two", "key", "spare"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch(kind: str, size: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * size) if c == "kind" else pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names)

    def run(batches):
        doc_id, spare, count, keys = [], [], [], []
        for x in batches:
            sets = x.filter(pa.compute.is_valid(x.column("doc_id")))
            if sets.num_rows:
                yield batch("set", sets.num_rows, **{c: sets.column(c) for c in ("doc_id", "n_shingles", "digest", "sketch")})
            for blob in x.column("blob").drop_null().to_pylist():
                n = int.from_bytes(blob[:4], "little")
                for c, kind, at in ((doc_id, "<i8", 4), (spare, "<i8", 4 + 8 * n), (count, "<u4", 4 + 16 * n)):
                    c.append(np.frombuffer(blob, kind, n, at))
                keys.append(np.frombuffer(blob, "<u8", -1, 4 + 20 * n))
        if not keys:
            return
        doc_id, spare, count, keys = (np.concatenate(c) for c in (doc_id, spare, count, keys))
        k, d, s, first, two = met_in(keys, doc_id, spare, np.repeat(np.arange(len(count)), count))
        del doc_id, spare, count, keys, x
        give_back()
        vote = d != first
        order = np.lexsort((first[vote], d[vote]))
        a, b, t = d[vote][order], first[vote][order], two[vote][order]
        if len(a):
            at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            n, t, a, b = np.diff(np.append(at, len(a))), np.add.reduceat(t.astype(np.int64), at), a[at], b[at]
            for i in range(0, len(a), EMIT):
                j = slice(i, i + EMIT)
                yield batch("vote", len(a[j]), doc_id=a[j], b=b[j], n=n[j], two=t[j])
        k, d, s = k.view(np.int64)[~two], d[~two], s[~two]
        for i in range(0, len(k), EMIT):
            j = slice(i, i + EMIT)
            yield batch("key", len(k[j]), doc_id=d[j], key=k[j], spare=s[j])

    dealt = key_blobs(nodes, parts).repartitionById(parts, "part")
    found = dealt.mapInArrow(run, "kind string, doc_id long, n_shingles long, digest binary, sketch array<long>, b long, n long, two long, key long, spare long")
    return stored(found, "jaccard-found", "kind")


def packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Compressed texts of the documents with these ids, stored; where ids outnumber the filter's bits, of the others too."""
    return stored(compressed(docs.select("doc_id", "text"), Marked("doc_id", marks(ids))), "jaccard-texts")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), stored, that their sizes and sketches allow to be similar."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").where(allowed()).select("a", "b").distinct(), "jaccard-pairs")


def allowed() -> Column:
    apart = sum((F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    most = F.floor((100 - PERCENT) * (F.col("na") + F.col("nb")) / (100 + PERCENT))
    return (apart <= most) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))


def similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar, stored, compared as whole sets."""
    z = packed(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(z.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b")

    def start():
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def each(batch: pa.RecordBatch) -> dict:
            known: dict[bytes, np.ndarray] = {}

            def found(z: bytes) -> np.ndarray:
                if z not in known:
                    known[z] = shingle_set(unpack(z))
                return known[z]

            keep = []
            for za, zb in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
                r, s = found(za), found(zb)
                common = len(np.intersect1d(r, s, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(r) + len(s) - common))
            at = np.flatnonzero(keep)
            return {"a": batch.column("a").take(pa.array(at)), "b": batch.column("b").take(pa.array(at))}

        return each

    return stored(in_batches(both.select("a", "b", "za", "zb"), "a long, b long", start), "jaccard-links")


def open_rows(rows: DataFrame) -> DataFrame:
    """Of rows (key, doc_id, spare, c: component): those of keys that join different components, with the key's size; stored."""
    rows = stored(rows, "jaccard-keys")
    keys = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("key", "size")
    return stored(rows.join(keys, "key").select("key", "doc_id", "spare", "c", "size"), "jaccard-open")


def hub_pairs(s: DataFrame) -> DataFrame:
    """For each document, the hub of another component that it shares most keys with: in a key, the one with most open keys."""
    degree = s.groupBy("doc_id").agg(F.count("*").alias("degree"))
    hubs = s.join(degree, "doc_id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("minus"), "c")).alias("hub")).select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.c").alias("hub_c"))
    votes = s.join(hubs, "key").where("c != hub_c").groupBy("doc_id", "hub").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    return best.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def cross_pairs(s: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs across components that share a key of three documents or more."""
    # All such keys that two sets in different components share are open, so each set may leave out its most common ones.
    rank = F.row_number().over(Window.partitionBy("doc_id", "spare").orderBy(F.desc("size"), "key"))
    live = s.withColumn("rank", rank).where(F.col("rank") >= F.col("spare") % 2**32).select("key", "doc_id", "c")
    live = stored(live.join(sets.select("doc_id", F.col("n_shingles").alias("n"), "sketch"), "doc_id"), "jaccard-live")
    # Pairs meet in a key and a band of sizes: similar sets' sizes differ by a quarter at most, less than a band.
    band = F.floor(F.log("n") / math.log(BAND)).cast("int")
    side = lambda x, bands: live.select("key", bands.alias("band"), F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("sketch").alias(f"s{x}"))
    a, b = side("a", band), side("b", F.explode(F.array(band, band - 1)))
    pairs = a.join(b, ["key", "band"]).where((F.struct("na", "a") < F.struct("nb", "b")) & (F.col("ca") != F.col("cb")) & allowed())
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(rows: DataFrame, column: str, label: DataFrame, name: str = "c") -> DataFrame:
    """rows with the component of the document in ``column``, which is its own where it has no link."""
    return rows.join(label.select(F.col("id").alias(column), F.col("component_id").alias("_c")), column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    nodes = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    known = nodes.where("doc_id is not null")
    found = found_in(known)
    rows = found.where("kind = 'set'").select("doc_id", "n_shingles", "digest", "sketch")
    votes = found.where("kind = 'vote'").groupBy("doc_id", "b").agg(F.sum("n").alias("n"), F.sum("two").alias("two"))
    repeats = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    one = known.groupBy("doc_id").agg(F.min("text").alias("text")) if repeats else known
    copies = stored(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("digest", "b"), "jaccard-copies")
    same = stored(rows.join(copies, "digest").where("doc_id != b").select(F.col("doc_id").alias("a"), "b"), "jaccard-links")
    # Round 1: each document and the first one that it shares most keys with, unless they are copies.
    votes = stored(votes, "jaccard-votes")
    star = votes.groupBy("doc_id").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")).select(F.col("doc_id").alias("a"), "b")
    star = likely(star.join(same, ["a", "b"], "left_anti").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), rows)
    label = stored(components(similar(star, one).unionByName(same)), "jaccard-labels")
    # Round 2: the same with hubs, as copies of one text with different changes are like it rather than one another. Of copies, one stands for all.
    keys = found.where("kind = 'key'").select("key", "doc_id", "spare").join(same.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    open_keys = open_rows(labelled(keys, "doc_id", label))
    hubs = likely(hub_pairs(open_keys).join(star, ["a", "b"], "left_anti"), rows)
    label2 = stored(components(between(similar(hubs, one), label)), "jaccard-labels")
    # Round 3: all that is left across components.
    of_two = labelled(labelled(votes.where("two > 0").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")), "a", label, "ca"), "b", label, "cb")
    of_two = labelled(labelled(of_two, "ca", label2, "la"), "cb", label2, "lb").where("la != lb").select("a", "b")
    still = open_rows(labelled(open_keys.select("key", "doc_id", "spare", "c"), "c", label2))
    more = likely(cross_pairs(still, rows).unionByName(of_two).join(star.unionByName(hubs), ["a", "b"], "left_anti"), rows)
    last = components(between(similar(more, one), label).unionByName(label2.where("id != component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))))
    out = labelled(labelled(rows.select("doc_id", "n_shingles"), "doc_id", label), "c", last, "component_id")
    return out.select("doc_id", "n_shingles", "component_id").unionByName(in_null(nodes))


def between(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links (a, b) of documents as links of their components."""
    return labelled(labelled(links, "a", label, "ca"), "b", label, "cb").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def in_null(nodes: DataFrame) -> DataFrame:
    """Rows without doc_id: sets of their own, linked with nothing."""

    def start():
        return lambda batch: {"doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(shingle_set(t)) for t in batch.column("text").to_pylist()], pa.int64()), "component_id": pa.nulls(batch.num_rows, pa.int64())}

    return in_batches(nodes.where("doc_id is null"), "doc_id long, n_shingles long, component_id long", start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the rows with the least doc_id; all of them if that repeats.

    Rows without a doc_id can't be told apart by it and are kept; documents without words are like no other and are kept. Columns keep
    their names, whatever they are; an empty table stays empty.
    """
    name = unused(docs, "kept")
    keep = jaccard_join(docs).where("component_id = doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(keep, F.col("doc_id").cast("long") == F.col(name), "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)
