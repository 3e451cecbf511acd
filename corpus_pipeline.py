"""The corpus pipeline: five operators in a row, each written and read again as Parquet.

Toxic documents go, one document of each group of near copies stays, contaminated documents go, personal
data is replaced, and what is left is encoded as byte-level BPE ids and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import stages
from claimloom.llm.common import load, scratch
from claimloom.storage import drop

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("pii", stages.redact_pii),
    ("byte_level_bpe", stages.encode_bytes),
]

#: Neither the classifier nor XXH64 nor the merges can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the ``documents`` of ``sf_dir``.  A stage's table goes when the next one is written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
