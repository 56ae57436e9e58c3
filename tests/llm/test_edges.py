"""Odd rows through the operators: empty tables, rows that share or lack an id, clashing names of columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.llm import embedding_dedup, html_extraction, packing, rule_classifier, secret_scan, substring_dedup, token_files
from tactus.llm.tokens import vocabulary_path

TEXTS = [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (3, "alpha beta gamma"), (3, "delta"), (4, None), (5, ""), (6, "token = abcdef1")]
CLASH = ["n", "node", "cell", "v", "kind", "spans", "found", "id", "word", "part", "score_", "h", "z", "key", "digest", "c"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in TEXTS], "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def test_vectors_that_share_ids_or_are_none(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.001]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (7, None), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in embedding_dedup.embedding_links(df).collect())
    assert [(i, n) for i, n, _, _ in got] == [("1", 1), ("1", 2), ("1", 2), ("2", 1), ("7", 0), ("8", 0), ("None", 2)]
    assert {i: c for i, _, c, _ in got if i in "278"} == {"2": "1", "7": "7", "8": "8"}
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_pages_that_share_ids_or_are_none(spark):
    page = lambda t: f"<html><body><nav>menu</nav><article><p>{t}</p></article></body></html>"
    rows = [(1, "http://a/1", page("one")), (1, "http://a/1", page("one")), (1, "http://a/2", page("two")), (None, None, page("three")), (2, "http://a/3", ""), (3, "http://a/4", page("word " * 200_000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in [*CLASH, "host", "tokens", "template", "blocks"]])
    got = sorted((repr(r.page_id), r.text[:10], r.n_chars) for r in html_extraction.extract(df).collect())
    assert got == [("1", "one", 3), ("1", "one", 3), ("1", "two", 3), ("2", "", 0), ("3", "word word ", 999_999), ("None", "three", 5)]
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_documents_that_share_ids_or_have_none(spark, docs, tmp_path):
    removed = substring_dedup.substring_dedup(docs).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed) for r in removed) == sorted((repr(d), len((t or "").split()), 0) for d, t in TEXTS)
    spans = secret_scan.secret_spans(docs).collect()
    assert sorted((repr(r.doc_id), len(r.spans)) for r in spans) == sorted((repr(d), int((t or "").startswith("token"))) for d, t in TEXTS)
    token_files.write_token_files(docs, f"file://{tmp_path}/t", vocabulary_path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, f"file://{tmp_path}/t").count() == len(TEXTS)


def test_pieces_of_rows_that_are_equal(spark, docs):
    got = packing.pack(docs, vocabulary_path("byte_bpe_50k.json")).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    whole = sorted((repr(r.doc_id), r.start, r.length, hashlib.md5(bytes(r.ids)).hexdigest()) for r in got)
    again = sorted((repr(r.doc_id), r.start, r.length, hashlib.md5(bytes(r.ids)).hexdigest()) for r in packing.pack(docs.repartition(5), vocabulary_path("byte_bpe_50k.json")).collect())
    assert whole == again and sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    per = {}
    for r in got:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(np.cumsum([0, *[n for _, n in sorted(p)]])[:-1].tolist() == [o for o, _ in sorted(p)] for p in per.values())


def test_classifier_scores_every_document(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    plain = rule_classifier.query(spark, d).collect()
    assert {(r.doc_id, r.held_out) for r in plain} == {(r.doc_id, r.held_out) for r in plain if 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)}
    assert docs.count() == len(plain) and labels.count() > 0
