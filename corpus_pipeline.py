"""The corpus pipeline: five stages over ``documents``, each on what its
predecessor kept, written as parquet and read again.

Stages take (spark, docs, sf_dir).  All but the last return the columns of
``documents``; the last returns the packed pieces.

Defined results: null and empty texts fail the quality rules; of rows that
repeat a doc_id one passes the near-duplicate stage, rows without a doc_id all
pass it; columns beyond those of ``documents`` pass unchanged, whatever their
names, up to the packing; empty tables give no pieces (without labels every
document with enough words has ratio 0 and stays; without benchmark items none
is contaminated).
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from specsift.llm import decontaminate, line_dedup, near_dup, quality_rules  # noqa: E402
from specsift.llm.queries import pack  # noqa: E402
from specsift.session import ship_package, write_stage  # noqa: E402


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; good labels are the trusted target."""
    return quality_rules.drop_low_quality(docs, _table(spark, sf_dir, "labels").filter("quality = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated cross-site lines."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    return near_dup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens along the Hilbert curve."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: The quality verdict hashes words and the packing tokenises: SQL cannot
#: express them; tests/llm/test_pipeline.py has a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
