"""Retrieval evaluation (A13) with expected ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import expected_rank
from ..session import write_stage


def retrieval_eval(hits: DataFrame, expected: DataFrame, tolerance: int = 2) -> tuple[DataFrame, DataFrame]:
    """hits: query_id, rank (1-based), name; expected: case, query_id, name, position (0-based).

    Returns (per-query rows with found position and pass flag, per-case summary).
    A query passes when the expected name is in its list at position <=
    expected position + tolerance.
    """
    expected = write_stage(expected, "expected")  # read twice
    ranks = expected_rank(hits.select("query_id", "rank", "name"), expected.select("query_id", "name"), ["query_id"])
    found = ranks.withColumnRenamed("position", "position_found")
    per_query = expected.join(found, ["query_id", "name"], "left").select(
        "case", "query_id", "name", "position", "position_found",
        (F.col("position_found").isNotNull() & (F.col("position_found") <= F.col("position") + tolerance))
        .alias("passed"),
    )
    summary = per_query.groupBy("case").agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")).withColumn(
        "pct", F.col("passed") * 100.0 / F.col("total"))
    return per_query, summary
