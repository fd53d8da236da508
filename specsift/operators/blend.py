"""Score blending: max-normalise (A2), name-keyed hybrid merge (J7) and
best-over-variations (A3).  All inputs are small (queries x depth rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import top_k


def max_normalize(df: DataFrame, keys: Sequence[str], score: str = "score", out: str = "norm") -> DataFrame:
    """A2: score / max(score) per key group; 0 when the max is <= 0.

    A window over the groups: a join with their maxima would run the search
    behind ``df`` twice.  Rows with a null key have no group."""
    mx = F.max(score).over(Window.partitionBy(*keys))
    return df.dropna(subset=list(keys)).withColumn("_mx", mx).withColumn(
        out, F.when(F.col("_mx") > 0, F.col(score) / F.col("_mx")).otherwise(F.lit(0.0))
    ).drop("_mx")


def hybrid_combine(sem: DataFrame, kw: DataFrame, keys: Sequence[str], n: int, keyword_weight: float) -> DataFrame:
    """Merge a semantic and a keyword top list by entry *name*.

    Per name: (1-w) * normalised score of its last semantic row, plus w *
    normalised score of each keyword row, summed in keyword rank order.  Ties
    keep first-seen order: semantic names by first semantic rank, then
    keyword-only names by first keyword rank.
    """
    keys = list(keys)
    sem_w = 1 - keyword_weight  # evaluated exactly as the reference does
    s = max_normalize(sem, keys).withColumn("c", F.col("norm") * F.lit(sem_w))
    s = s.groupBy(*keys, "name").agg(
        F.max_by(F.struct("entry_pos", "c"), F.col("rank")).alias("last"),
        F.min("rank").alias("first_s"),
    )
    k = max_normalize(kw, keys).withColumn("c", F.col("norm") * F.lit(keyword_weight))
    k = k.groupBy(*keys, "name").agg(
        F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("cs"),
        F.min_by("entry_pos", "rank").alias("kw_entry"),
        F.min("rank").alias("first_k"),
    )
    j = s.join(k, keys + ["name"], "full")
    score = F.aggregate(
        F.coalesce("cs", F.array().cast("array<struct<rank:int,c:double>>")),
        F.coalesce(F.col("last.c"), F.lit(0.0)),
        lambda acc, x: acc + x["c"],
    )
    j = j.select(
        *keys, "name",
        F.coalesce(F.col("last.entry_pos"), F.col("kw_entry")).alias("entry_pos"),
        score.alias("score"),
        F.when(F.col("last").isNotNull(), F.lit(0)).otherwise(F.lit(1)).alias("_grp"),
        F.coalesce("first_s", "first_k").alias("_first"),
    )
    out = top_k(j, keys, n, [F.col("score").desc(), F.col("_grp").asc(), F.col("_first").asc()])
    return out.drop("_grp", "_first")


def best_over_variations(hits: DataFrame, key: str, var_col: str, n: int) -> DataFrame:
    """A3 + W1: per (query, name) best score (ties: earliest variation); order
    ties by first appearance (variation, rank); keep n per query."""
    best = hits.groupBy(key, "name").agg(
        F.max_by(F.struct("entry_pos", "score"), F.struct(F.col("score"), -F.col(var_col))).alias("b"),
        F.min(F.struct(F.col(var_col), F.col("rank"))).alias("_first"),
    ).select(key, "name", "b.entry_pos", "b.score", "_first")
    return top_k(best, [key], n, [F.col("score").desc(), F.col("_first").asc()]).drop("_first")
