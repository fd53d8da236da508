"""Windows, sorts and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    order: Sequence[Column],
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the first k rows per key group under a total order.

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit
    below the exchange, so only k rows per key and input partition shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def first_per_key(df: DataFrame, key: str, order_col: str = "entry_pos") -> DataFrame:
    """The first row per key in corpus order (name lookup, first match wins)."""
    w = Window.partitionBy(key).orderBy(F.col(order_col).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def examples_per_group(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group plus how many more the group holds.

    The window keeps n rows per group and task before the shuffle, and the
    counts are added up per task: no task sees a whole group."""
    counts = df.groupBy(key).agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).alias("more"))
    return top_k(df, [key], n, order, "example_no").join(counts, key)


def expected_rank(hits: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0-based position of the expected name in each result list (null if absent)."""
    j = expected.join(hits, list(keys) + ["name"], "left")
    return j.groupBy(*keys, "name").agg(F.min(F.col("rank") - 1).alias("position"))
