"""Shared helpers: partitioning of coarse inputs, written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` only when the input is too coarse to use the
    cluster (e.g. one parquet row group -> one task).  Inputs that already
    have at least ``defaultParallelism`` splits, or that a shuffle has dealt,
    pass through."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # asking for its partitions would run the shuffle
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= par:
        return df
    target = 2 * par  # a little slack for uneven rows (long documents)
    return df.repartition(target, *keys) if keys else df.repartition(target)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back (``session.write_stage``): a corpus
    index that several scorers and joins read."""
    from ..session import write_stage

    return write_stage(df, "table")
