"""The queries of this subpackage and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_dedup, filter_audit, html_extraction, jaccard_join, mixing, packing, quality_rules, rule_classifier, secret_scan, substring_dedup, token_files, vector_codes


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_embedding_dedup": embedding_dedup.query,
        "op4_token_files": token_files.query,
        "op5_rule_classifier": rule_classifier.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_packing": packing.query,
        "op8_mixing": mixing.query,
        "op9_html_extraction": html_extraction.query,
        "op10_secret_scan": secret_scan.query,
        "op11_filter_audit": filter_audit.query,
        "op12_vector_codes": vector_codes.query,
        "op13_byte_bpe": byte_bpe.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
    }
