"""The training-data pipeline: filters, deduplicates, masks, mixes and encodes the table ``documents``.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.bpe import bpe_stage
from shelfmark.llm.common import new_path
from shelfmark.llm.dartminhash import near_duplicate_stage
from shelfmark.llm.mixing import fair_queue_stage
from shelfmark.llm.secretscan import secrets_stage
from shelfmark.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", fair_queue_stage),
    ("bpe_encoding", bpe_stage),
]

#: Learned lexicons, sampled signatures and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
