"""A corpus pipeline over the documents: quality rules, near duplicates, secrets, mixing, packing."""

from pyspark.sql import DataFrame, SparkSession

from tactus.llm import jaccard_join, mixing, packing, quality_rules, secret_scan
from tactus.llm.common import stored, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_duplicates", jaccard_join.stage),
    ("secret_scans", secret_scan.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The stages tokenize, solve for rates and pack: no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written as Parquet and read again as the next one's documents.

    Null texts count as empty ones, and rows without a doc_id stay unless the rules reject them; of rows that share a doc_id each is judged
    by itself, and all or none are kept as near duplicates. Ties are settled by doc_id. Columns whose names clash with those of
    the stages are carried to the last one, which gives pieces of sequences. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
