"""Query side of a search batch: one written table, cut into hash buckets.

Each query's distinct terms and hashed ids are computed once and written under
the checkpoint folder.  Queries stay rows: a search sends every bucket (a
bounded number of queries) to the tasks that hold corpus rows for it, and
nothing of them passes through the driver but their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import hashed_ids
from ..functions.text import terms
from ..session import write_stage, write_stages

#: Queries that meet a block of corpus rows at once.  The corpus is sent once for each bucket.
BUCKET_QUERIES = 32768
#: Buckets that meet the corpus at once: so many copies of it are in shuffle files at a time.
WAVE = 2


@dataclass
class QueryBatch:
    rows: DataFrame  # bucket, keys..., and what the scorers read (terms, ids)
    keys: list[str]
    buckets: int
    queries: int

    @property
    def key_fields(self) -> list[T.StructField]:
        return [self.rows.schema[k] for k in self.keys]

    def groups(self, corpus_blocks: int) -> int:
        """Groups of corpus blocks that each bucket meets: enough for all cores."""
        cores = self.rows.sparkSession.sparkContext.defaultParallelism
        return max(1, min(corpus_blocks, -(-2 * cores // self.buckets)))

    @property
    def waves(self) -> int:
        return -(-self.buckets // WAVE)

    def part(self, lo: int, hi: int) -> QueryBatch:
        """The buckets from lo to before hi, as a batch."""
        rows = self.rows.where(F.col("bucket").between(lo, hi - 1)).withColumn("bucket", F.col("bucket") - F.lit(lo))
        return QueryBatch(rows, self.keys, hi - lo, self.queries)


def in_waves(batch: QueryBatch, run: Callable[[QueryBatch], DataFrame], name: str) -> DataFrame:
    """``run`` of the whole batch, ``WAVE`` buckets at a time: shuffle files then
    grow with the corpus and not with the corpus times the buckets."""
    if batch.waves == 1:
        return run(batch)
    return write_stages((run(batch.part(lo, min(lo + WAVE, batch.buckets))) for lo in range(0, batch.buckets, WAVE)), name)


def query_batch(rows: DataFrame, keys: Sequence[str]) -> QueryBatch:
    """Writes prepared rows once and cuts them into buckets by their keys."""
    rows = write_stage(rows, "queries")
    queries = rows.count()
    buckets = max(1, -(-queries // BUCKET_QUERIES))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    return QueryBatch(rows.select(bucket.alias("bucket"), *rows.columns), list(keys), buckets, queries)


def prepare_queries(queries: DataFrame, keys: Sequence[str], text_col: str, dims: int) -> QueryBatch:
    """keys..., terms, ids of every query."""
    return query_batch(queries.select(*keys, terms(text_col).alias("terms"), hashed_ids(text_col, dims).alias("ids")), keys)


def meet(batch: QueryBatch, query_cols: Sequence[str], corpus: DataFrame, groups: int) -> DataFrame:
    """Queries and corpus rows of each (bucket, group) in one task, queries first.

    ``corpus`` has bucket and grp; rows come sorted by bucket, grp, then the
    corpus's ``shard`` and ``kind``.  A query row has shard -1 and kind 0.
    """
    keys = [F.col(k).alias(f"key_{k}") for k in batch.keys]
    copies = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    q = batch.rows.select("bucket", F.lit(-1).cast("long").alias("shard"), F.lit(0).alias("kind"), *keys, *query_cols)
    q = q.select("*", copies.alias("grp"))
    both = q.unionByName(corpus, allowMissingColumns=True)
    # a list that a row does not have is empty: Arrow writes a run of n null lists in n * n steps
    both = both.select(*[F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else f.name
                         for f in both.schema])
    cell = (F.col("bucket") * F.lit(groups) + F.col("grp")).cast("int")
    return both.repartitionById(batch.buckets * groups, cell).sortWithinPartitions("bucket", "grp", "shard", "kind")


def cells(
    batches: Iterator[pa.RecordBatch], columns: Sequence[str] = ("bucket", "grp", "shard"), whole: bool = True
) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(values of ``columns``, their rows) of a stream sorted by them.

    With ``whole`` the rows of a cell come together, else as they arrive.
    """
    held, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        new = np.logical_or.reduce([x[1:] != x[:-1] for x in at])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(batch.column(c)[a].as_py() for c in columns)
            if parts and (key != held or not whole):
                yield held, parts
                parts = []
            held = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield held, parts
