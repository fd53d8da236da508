"""Cosine scoring (J6): a first pass in 32 bits and exact re-ranking.

Queries are rows cut into buckets; corpus rows are dealt into groups, and every
(bucket, group) meets in one task (``operators.queries.meet``), which streams
its corpus rows in chunks and keeps a running top n per query.

A vector is coded: ``code = round(v / step)``, 8 bits, or step 1 where all
entries are whole and below 2**15.  The product of the codes, summed in 32-bit
floats at length 1 (off by the rounding of so many sums), is off by at most

    |e.q - e'.q'| <= |e - e'| |q| + |e'| |q - q'|

where ' marks what the codes stand for.  Rows whose bound does not reach a
query's running n-th best cosine are dropped; the cosines of all others come
from the vectors themselves in double precision, so the result is exact.  The
product of whole vectors is whole: where its error is below a half it is rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_stage
from .blocks import merge_topn
from .queries import QueryBatch, cells, in_waves, meet
from .topk import top_k

CHUNK_ROWS = 4096
#: Queries compared with a chunk at once.
QUERY_ROWS = 1024
#: Pairs scored exactly at once.
PAIRS = 1 << 14


def cosine_topn(corpus: DataFrame, batch: QueryBatch, n: int, dims: int, corpus_ids: str = "ids",
                extra: Sequence[str] = ("name",), kind: str = "ids", query_col: str = "ids") -> DataFrame:
    """Top n entries per query by cosine.

    corpus: entry_pos, <extra...>, <corpus_ids>: signed bucket ids (``kind="ids"``,
    the hashing encoder) or dense ``array<float>`` vectors (``kind="dense"``, a
    model encoder); the batch's ``query_col`` holds the same kind.
    Output: keys..., entry_pos, extra..., score, rank.
    """
    extra = list(extra)
    # counts in 8 bits take a fifth of the ids
    pack, kind = (packed(dims), "packed") if kind == "ids" else (F.col, kind)
    vectors = corpus.select("entry_pos", *extra, pack(corpus_ids).alias("vector"))
    if batch.waves > 1:
        vectors = write_stage(vectors, "packed")  # every wave reads it
    schema = T.StructType([*batch.key_fields, T.StructField("entry_pos", T.LongType()), *[corpus.schema[c] for c in extra],
                           T.StructField("score", T.DoubleType())])

    def found(part: QueryBatch) -> DataFrame:
        groups = part.groups(1 << 16)
        buckets = F.explode(F.sequence(F.lit(0), F.lit(part.buckets - 1)))
        rows = vectors.select(
            F.lit(0).cast("long").alias("shard"), F.lit(1).alias("kind"), F.col("entry_pos"), *[F.col(c).alias(f"extra_{c}") for c in extra],
            "vector", F.pmod(F.xxhash64("entry_pos"), F.lit(groups)).cast("int").alias("grp"), buckets.alias("bucket"))
        met = meet(part, [pack(query_col).alias("vector")], rows, groups)
        scored = met.mapInArrow(_topn(part.keys, extra, n, dims, kind), schema)
        return top_k(scored, part.keys, n, [F.col("score").desc(), F.col("entry_pos").asc()])

    return in_waves(batch, found, "nearest")


def packed(dims: int) -> Callable[[str], Column]:
    """Signed bucket ids as the counts of all buckets, in the fewest bytes that hold
    those of an Arrow batch: a row's width is its length / ``dims``.  A null is null."""

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        counts = matrix(column, dims, "ids")
        most = np.abs(counts).max(initial=0)
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
        data = counts.astype(f"<i{width}").tobytes()
        ends = pa.array(np.arange(len(column) + 1) * (dims * width), pa.int32())
        rows = pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, ends.buffers()[1], pa.py_buffer(data)])
        return pc.if_else(column.is_valid(), rows, pa.scalar(None, pa.binary())) if column.null_count else rows

    return pack


def matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    """Vectors as rows: counts of signed ids, packed counts, or dense vectors; a null is zero."""
    n = len(column)
    if kind == "packed":
        out = np.zeros((n, dims))
        width = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // dims
        for w in np.unique(width[width > 0]):
            at = np.flatnonzero(width == w)
            data = b"".join(column.take(pa.array(at)).to_pylist())
            out[at] = np.frombuffer(data, f"<i{w}").reshape(len(at), dims)
        return out
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    if kind == "ids":
        at = np.repeat(np.arange(n) * dims, lengths) + (np.abs(values).astype(np.int64) - 1)
        return np.bincount(at, weights=np.sign(values).astype(float), minlength=n * dims).reshape(n, dims)
    out = np.zeros((n, dims))
    out[lengths > 0] = values.reshape(-1, dims)
    return out


class Coded:
    """Codes of the rows of a matrix at length 1, with what bounds their error."""

    def __init__(self, m: np.ndarray):
        self.square = (m * m).sum(axis=1)
        top = np.abs(m).max(axis=1, initial=0)
        step = np.where(top > 0, top / 127, 1.0)
        whole = (m == np.rint(m)).all(axis=1)
        step[(top < 1 << 15) & whole] = 1.0
        stands = np.rint(m / step[:, None])
        stands *= step[:, None]
        norm = np.sqrt(self.square)
        per = np.where(norm > 0, 1 / np.where(norm > 0, norm, 1), 0)
        self.unit = (stands * per[:, None]).astype(np.float32)
        self.kept = np.sqrt((stands * stands).sum(axis=1)) * per
        stands -= m
        self.lost = np.sqrt((stands * stands).sum(axis=1)) * per
        self.counts = bool(whole.all() and top.max(initial=0) < 1 << 15)
        self.exact = m.astype(np.int16) if self.counts else m


def products(e: Coded, q: Coded) -> tuple[np.ndarray, np.ndarray | float]:
    """(products of the codes of all rows of q and e, by how much the cosines can differ)."""
    near = q.unit @ e.unit.T
    # 32-bit sums and the rounding of the codes at length 1
    off = (near.dtype.type(2.0**-23) * (q.unit.shape[1] + 8)).astype(np.float64)
    if e.lost.any():
        off = off + e.lost[None, :]
    if q.lost.any():
        off = off + e.kept[None, :] * q.lost[:, None]
    return near, off


def bounds(e: Coded, q: Coded) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the cosines of all rows of e and q."""
    near, off = products(e, q)
    return (near - off).T, (near + off).T


class _Best:
    """The running n best corpus rows of every query."""

    def __init__(self, rows: pa.Table, n: int, dims: int, kind: str):
        self.rows, self.n = rows, n
        vector = rows["vector"].combine_chunks()
        self.coded = [Coded(matrix(vector.slice(lo, QUERY_ROWS), dims, kind)) for lo in range(0, len(vector), QUERY_ROWS)]
        self.q = np.zeros(0, np.int64)
        self.position, self.score, self.extra = np.zeros(0, np.int64), np.zeros(0), None
        # score and position of the n-th best
        self.bar, self.last = np.full(rows.num_rows, -np.inf), np.zeros(rows.num_rows, np.int64)

    def offer(self, e: Coded, position: np.ndarray, extra: list[pa.Array]) -> None:
        found = [self._reach(e, i, position) for i in range(len(self.coded))]
        self._merge(*[np.concatenate(x) for x in zip(*found)], position, extra)

    def _reach(self, e: Coded, part: int, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of e, query, cosine) of what can be among the n best of a part's queries."""
        coded, lo = self.coded[part], part * QUERY_ROWS
        near, off = products(e, coded)
        some = e.square > 0
        if not some.all():
            near[:, ~some] = -np.inf
        bar = self.bar[lo : lo + QUERY_ROWS].copy()
        new = np.flatnonzero(np.isinf(bar) & (coded.square > 0))
        if len(new) and near.shape[1] >= self.n:
            lower = near[new] - (off[new] if np.ndim(off) and len(off) > 1 else off)
            bar[new] = np.partition(lower, near.shape[1] - self.n, axis=1)[:, near.shape[1] - self.n]
        bar[coded.square <= 0] = np.inf
        if np.ndim(off):
            kept = near + off >= bar[:, None]
        else:  # in 32 bits, rounded down
            kept = near >= np.nextafter((bar - off).astype(np.float32), np.float32(-np.inf))[:, None]
        q, row = np.nonzero(kept if some.all() else kept & some[None, :])
        length = np.sqrt(e.square[row] * coded.square[q])
        # a product of whole numbers is the whole number next to it
        dots = np.rint(near[q, row] * length)
        far = np.flatnonzero(length * off >= 0.49) if not np.ndim(off) and e.counts and coded.counts else np.arange(len(row))
        for a in range(0, len(far), PAIRS):
            at = far[a : a + PAIRS]
            dots[at] = (e.exact[row[at]].astype(np.float64) * coded.exact[q[at]]).sum(axis=1)
        score, q = dots / length, q + lo
        # of equal scores the first positions are the best
        kept = (score > self.bar[q]) | (score == self.bar[q]) & (position[row] < self.last[q])
        return row[kept], q[kept], score[kept]

    def _merge(self, row, q, score, position, extra) -> None:
        mine = [x.take(pa.array(row)) for x in extra]
        if self.extra is not None:
            mine = [pa.concat_arrays([a, b]) for a, b in zip(self.extra, mine)]
        all_q = np.concatenate([self.q, q])
        all_position, all_score = np.concatenate([self.position, position[row]]), np.concatenate([self.score, score])
        top = merge_topn(all_q, all_position, all_score, self.n)
        self.q, self.position, self.score = all_q[top], all_position[top], all_score[top]
        self.extra = [x.take(pa.array(top)) for x in mine]
        full = np.flatnonzero(np.bincount(self.q, minlength=len(self.bar)) == self.n)
        last = np.searchsorted(self.q, full, side="right") - 1
        self.bar[full], self.last[full] = self.score[last], self.position[last]

    def result(self, keys: Sequence[str], extra: Sequence[str]) -> pa.RecordBatch | None:
        if not len(self.q):
            return None
        own = [self.rows[f"key_{k}"].combine_chunks().take(pa.array(self.q)) for k in keys]
        columns = [*own, pa.array(self.position), *self.extra, pa.array(self.score)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "entry_pos", *extra, "score"])


def _topn(keys: list[str], extra: list[str], n: int, dims: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cell = None, None
        for (bucket, grp, shard), parts in cells(batches, whole=False):
            if (bucket, grp) != cell:
                if best is not None and (found := best.result(keys, extra)) is not None:
                    yield found
                cell, best, queries = (bucket, grp), None, []
            if shard < 0:
                queries += parts
                continue
            if best is None and queries:
                best = _Best(pa.Table.from_batches(queries), n, dims, kind)
            for part in parts if best is not None else []:
                for at in range(0, part.num_rows, CHUNK_ROWS):
                    rows = part.slice(at, CHUNK_ROWS)
                    coded = Coded(matrix(rows.column("vector"), dims, kind))
                    best.offer(coded, rows.column("entry_pos").to_numpy(), [rows.column(f"extra_{c}") for c in extra])
        if best is not None and (found := best.result(keys, extra)) is not None:
            yield found

    return run
