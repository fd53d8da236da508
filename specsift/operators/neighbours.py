"""Exact nearest neighbours of every entry (J8) and those above a threshold.

Entries with equal vectors are one variant that keeps its k + 1 earliest
positions, so a vector that a third of all entries share is one row.  Variants
are ordered by their nearest pivot (a bounded sample of the vectors) and the
angle to it, and cut into blocks of equal size: rings around a pivot.

1. Every block is compared with itself; a variant's k-th best angle so far (or
   the threshold's, if smaller) is its radius.
2. With a pivot p and a ring [lo, hi] around it, the triangle inequality of
   angles gives ``angle(x, y) >= max(angle(x, p) - hi, lo - angle(x, p))`` for
   all y of the block.  A variant visits the blocks whose bound is within its
   radius; all other pairs of blocks are pruned.
3. A task holds as many blocks as fit; a visitor is sent once to each task that
   holds blocks it visits, with their list.  What beats its radius meets in one
   top k per variant, and is expanded to the positions of both sides.

Matrix products choose candidates with a margin; the scores come from the pairs
themselves, so they do not depend on how rows were cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .blocks import merge_topn
from .queries import cells
from .topk import top_k
from .vectors import matrix

#: Variants of a block at least; blocks at most (their rings are known to every task); pivots at most.
BLOCK_ROWS = 2048
MAX_BLOCKS = 50_000
MAX_PIVOTS = 256
#: Rows by rows compared at once, and the margin of angles and cosines.
TILE = 1024
#: Bytes of vectors of the blocks that a task holds together.
HOST_BYTES = 32 << 20
MARGIN = 1e-6


@dataclass
class Blocks:
    rows: DataFrame  # block, variant, vector, copies
    pivots: np.ndarray  # unit vectors
    pivot: np.ndarray  # of each block
    low: np.ndarray  # ring: angles to the pivot
    high: np.ndarray
    number: np.ndarray  # block ids

    def may_hold(self, unit: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(rows x blocks): whether a block can have a row within the radius."""
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1, 1))[:, self.pivot]
        return np.maximum(angle - self.high, self.low - angle) <= (radius + MARGIN)[:, None]


class _Vectors:
    def __init__(self, table: pa.Table | pa.RecordBatch, dims: int, kind: str):
        column = table.column("vector")
        self.exact = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, dims, kind)
        self.square = (self.exact * self.exact).sum(axis=1)
        self.unit = self.exact / np.sqrt(np.where(self.square > 0, self.square, 1))[:, None]
        self.variant = table.column("variant").to_numpy()

    def take(self, rows: np.ndarray) -> _Vectors:
        part = object.__new__(_Vectors)
        part.__dict__ = {k: x[rows] for k, x in self.__dict__.items()}
        return part


def _best(a: _Vectors, b: _Vectors, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, cosine): each a's best k rows of b at its bar or above, without itself."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for lo in range(0, len(a.variant), TILE):
        at = slice(lo, min(lo + TILE, len(a.variant)))
        own, mine = bar[at].copy(), (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        for left in range(0, len(b.variant), 8 * TILE):
            to = slice(left, min(left + 8 * TILE, len(b.variant)))
            near = a.unit[at] @ b.unit[to].T
            near[a.variant[at][:, None] == b.variant[to][None, :]] = -np.inf
            cut = own
            if near.shape[1] > k:
                cut = np.maximum(own, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
            r, c = np.nonzero(near >= (cut - MARGIN)[:, None])
            score = (a.exact[at][r] * b.exact[to][c]).sum(axis=1) / np.sqrt(a.square[at][r] * b.square[to][c])
            ok = score >= own[r]
            mine = tuple(np.concatenate([x, y]) for x, y in zip(mine, (r[ok], c[ok] + left, score[ok])))
            top = merge_topn(mine[0], b.variant[mine[1]], mine[2], k)
            mine = tuple(x[top] for x in mine)
            full = np.flatnonzero(np.bincount(mine[0], minlength=len(own)) == k)
            own[full] = np.maximum(own[full], mine[2][np.searchsorted(mine[0], full, side="right") - 1])
        held = tuple(np.concatenate([x, y]) for x, y in zip(held, (mine[0] + lo, mine[1], mine[2])))
    return held


def _dimension(vectors: DataFrame, dims: int, kind: str) -> int:
    return dims if kind == "ids" else vectors.agg(F.max(F.size("vector"))).first()[0] or 1


def variants(vectors: DataFrame, k: int, vec_col: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(variant, vector, copies: its k + 1 earliest positions), (entry_pos, variant)."""
    vector = F.sort_array(F.col(vec_col)) if kind == "ids" else F.col(vec_col)
    v = vectors.select("entry_pos", vector.alias("vector")).where(F.size("vector") > 0)
    early = top_k(v, ["vector"], k + 1, [F.col("entry_pos").asc()])
    one = early.groupBy("vector").agg(F.sort_array(F.collect_list("entry_pos")).alias("copies"))
    one = write_stage(one.select(F.col("copies")[0].alias("variant"), "vector", "copies"), "neighbour-variants")
    return one, v.join(one.select("vector", "variant"), "vector").select("entry_pos", "variant")


def cut_into_blocks(one: DataFrame, dims: int, kind: str) -> Blocks | None:
    """Blocks of variants with a vector that is not zero; None without any."""
    n = one.count()
    count = max(1, min(MAX_PIVOTS, -(-n // BLOCK_ROWS) * 4))
    sample = one.orderBy(F.xxhash64("variant"), "variant").limit(count).select("variant", "vector").toArrow()
    if not n or not sample.num_rows:
        return None
    chosen = _Vectors(sample, dims, kind)
    pivots = chosen.unit[chosen.square > 0] if (chosen.square > 0).any() else np.eye(1, dims)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _Vectors(batch, dims, kind)
            cosine = v.unit @ pivots.T
            best = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
            out = batch.append_column("pivot", pa.array(best.astype(np.int32))).append_column("angle", pa.array(angle))
            yield out.filter(pa.array(v.square > 0))

    kind_of = one.schema["vector"].dataType.simpleString()
    schema = f"variant long, vector {kind_of}, copies array<long>, pivot int, angle double"
    size = max(BLOCK_ROWS, -(-n // MAX_BLOCKS))
    placed = one.select("variant", "vector", "copies").mapInArrow(near, schema)
    # equal ranges of (pivot, angle); a range may end one pivot and begin others
    ranged = placed.repartitionByRange(-(-n // size), "pivot", "angle", "variant")
    block = (F.spark_partition_id().cast("long") * (1 << 20) + F.col("pivot")).alias("block")
    rows = write_stage(ranged.select(block, "variant", "vector", "copies", "pivot", "angle"), "neighbour-blocks")
    # a row for each block: a bounded number
    rings = rows.groupBy("block", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("block").toPandas()
    if not len(rings):
        return None
    return Blocks(rows.select("block", "variant", "vector", "copies"), pivots, rings["pivot"].to_numpy(),
                  rings["low"].to_numpy(), rings["high"].to_numpy(), rings["block"].to_numpy())


_PAIRS = "variant long, other long, score double"


def _pairs(a: _Vectors, b: _Vectors, found) -> pa.RecordBatch:
    r, c, s = found
    return pa.RecordBatch.from_arrays([pa.array(a.variant[r]), pa.array(b.variant[c]), pa.array(s)], names=["variant", "other", "score"])


def _within(k: int, dims: int, kind: str, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in cells(batches, ["block"]):
            v = _Vectors(pa.Table.from_batches(parts), dims, kind)
            yield _pairs(v, v, _best(v, v, k, np.full(len(v.variant), floor)))

    return run


def _visits(blocks: Blocks, hosts: int, dims: int, kind: str, floor: float):
    """Rows go to the hosts (of ``hosts`` blocks each) of other blocks that can
    hold something within their radius, with the list of these blocks."""
    pivots = Blocks(None, blocks.pivots, blocks.pivot, blocks.low, blocks.high, blocks.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                v = _Vectors(batch, dims, kind)
                bar = np.maximum(batch.column("bar").to_numpy(zero_copy_only=False), floor)
                to = pivots.may_hold(v.unit, np.arccos(np.clip(bar, -1, 1)))
                to &= pivots.number[None, :] != batch.column("block").to_numpy()[:, None]
                row, block = np.nonzero(to)
                host = block // hosts
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (host[1:] != host[:-1])]) if len(row) else row
                # some hosts at a time: a batch holds about as many rows as it came with
                for lo in range(0, len(first), 8 * TILE):
                    part = first[lo : lo + 8 * TILE]
                    end = np.append(first, len(row))[lo + 1 : lo + 1 + len(part)]
                    offsets = pa.array(np.append(part, end[-1]) - part[0], pa.int32())
                    wanted = pa.ListArray.from_arrays(offsets, pa.array(block[part[0] : end[-1]], pa.int32()))
                    sent = batch.select(["variant", "vector"]).take(pa.array(row[part]))
                    for name, column in (("bar", pa.array(bar[row[part]])), ("host", pa.array(host[part], pa.int64())), ("wanted", wanted)):
                        sent = sent.append_column(name, column)
                    yield sent

    return run


def _across(k: int, dims: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, parts = None, None, []
        for (host, part, side), rows in cells(batches, ["host", "part", "side"], whole=False):
            if (host, part) != held:
                held, members, parts = (host, part), None, []
            if side == 0:
                parts += rows
                continue
            if members is None:
                table = pa.Table.from_batches(parts)
                members = {int(n): _Vectors(table.filter(pa.array(table["number"].to_numpy() == n)), dims, kind)
                           for n in np.unique(table["number"].to_numpy())}
            for whole in rows:
                for at in range(0, whole.num_rows, TILE):
                    batch = whole.slice(at, TILE)
                    v, bar = _Vectors(batch, dims, kind), batch.column("bar").to_numpy().copy()
                    lengths = pc.list_value_length(batch.column("wanted")).to_numpy()
                    row, number = np.repeat(np.arange(len(bar)), lengths), pc.list_flatten(batch.column("wanted")).to_numpy()
                    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                    for n in np.unique(number):
                        asked = row[number == n]
                        r, c, score = _best(v.take(asked), members[int(n)], k, bar[asked])
                        found.append((asked[r], members[int(n)].variant[c], score))
                    r, other, score = (np.concatenate(x) for x in zip(*found))
                    top = merge_topn(r, other, score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(v.variant[r[top]]), pa.array(other[top]), pa.array(score[top])],
                                                     names=["variant", "other", "score"])

    return run


def nearest(vectors: DataFrame, k: int, vec_col: str = "v", kind: str = "dense", dims: int = 256, at_least: float = -1.0) -> DataFrame:
    """The k nearest other entries of every entry (cosine at ``at_least`` or
    more), ties by position: pos1, rank, pos2, score.  Exact."""
    one, members = variants(vectors, k, vec_col, kind)
    dims = _dimension(one, dims, kind)
    empty = vectors.sparkSession.createDataFrame([], "pos1 long, rank int, pos2 long, score double")
    blocks = cut_into_blocks(one, dims, kind)
    if blocks is None:
        return empty
    floor = max(at_least, -1.0) - (1e-12 if at_least <= -1 else 0)
    by_block = blocks.rows.select("block", "variant", "vector").repartition("block").sortWithinPartitions("block")
    inside = write_stage(by_block.mapInArrow(_within(k, dims, kind, floor), _PAIRS), "neighbours-within")
    bars = inside.groupBy("variant").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
    asked = blocks.rows.select("block", "variant", "vector").join(bars, "variant", "left").select(
        "block", "variant", "vector", F.coalesce("bar", F.lit(floor)).alias("bar"))
    kind_of = one.schema["vector"].dataType.simpleString()
    # blocks are numbered in the order of their rings: a host holds near ones
    hosts = max(1, HOST_BYTES // (16 * dims * max(BLOCK_ROWS, -(-one.count() // MAX_BLOCKS))))
    visits = asked.mapInArrow(_visits(blocks, hosts, dims, kind, floor),
                              f"variant long, vector {kind_of}, bar double, host long, wanted array<int>")
    # enough tasks for all cores, however few the hosts
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_hosts = -(-len(blocks.number) // hosts)
    parts = max(1, -(-2 * cores // n_hosts))
    part = F.pmod(F.xxhash64("variant"), F.lit(parts)).cast("int").alias("part")
    guests = visits.select("host", part, F.lit(1).alias("side"), "variant", "vector", "bar", "wanted")
    numbers = vectors.sparkSession.createDataFrame(
        [(int(b), i, i // hosts) for i, b in enumerate(blocks.number)], "block long, number int, host long")
    members_ = blocks.rows.join(F.broadcast(numbers), "block").select(
        "host", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"), "variant", "vector", "number")
    both = members_.unionByName(guests, allowMissingColumns=True)
    cell = (F.col("host") * F.lit(parts) + F.col("part")).cast("int")
    met = both.repartitionById(n_hosts * parts, cell).sortWithinPartitions("host", "part", "side")
    pairs = inside.unionByName(met.mapInArrow(_across(k, dims, kind), _PAIRS))
    best = top_k(pairs, ["variant"], k, [F.col("score").desc(), F.col("other").asc()]).drop("rank")
    copies = one.select(F.col("variant").alias("other"), "copies")
    square = _self_score(one, dims, kind, at_least)
    reach = best.join(copies, "other").select("variant", "score", F.explode("copies").alias("pos2")).unionByName(square)
    reach = top_k(reach, ["variant"], k + 1, [F.col("score").desc(), F.col("pos2").asc()]).drop("rank")
    out = members.join(reach, "variant").where("entry_pos <> pos2").select(F.col("entry_pos").alias("pos1"), "pos2", "score")
    return top_k(out, ["pos1"], k, [F.col("score").desc(), F.col("pos2").asc()]).select("pos1", "rank", "pos2", "score")


def _self_score(one: DataFrame, dims: int, kind: str, at_least: float) -> DataFrame:
    """Copies of a variant as its own neighbours (the entry itself among them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _Vectors(batch, dims, kind)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = v.square / np.sqrt(v.square * v.square)
            kept = pa.array((v.square > 0) & (score >= at_least))
            yield pa.RecordBatch.from_arrays([batch.column("variant"), pa.array(score), batch.column("copies")],
                                             names=["variant", "score", "copies"]).filter(kept)

    own = one.mapInArrow(run, "variant long, score double, copies array<long>")
    return own.select("variant", "score", F.explode("copies").alias("pos2"))


def pruned_share(vectors: DataFrame, k: int, vec_col: str = "v", kind: str = "dense", dims: int = 256, at_least: float = -1.0) -> float:
    """Share of (variant, other block) pairs that the bounds leave out, with the
    radius of the first round."""
    one, _ = variants(vectors, k, vec_col, kind)
    dims = _dimension(one, dims, kind)
    blocks = cut_into_blocks(one, dims, kind)
    if blocks is None or len(blocks.number) < 2:
        return 0.0
    by_block = blocks.rows.select("block", "variant", "vector").repartition("block").sortWithinPartitions("block")
    bars = by_block.mapInArrow(_within(k, dims, kind, at_least), _PAIRS).groupBy("variant").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
    asked = blocks.rows.select("block", "variant", "vector").join(bars, "variant", "left").select(
        "block", "variant", "vector", F.coalesce("bar", F.lit(at_least)).alias("bar"))
    kind_of = one.schema["vector"].dataType.simpleString()
    visits = asked.mapInArrow(_visits(blocks, 1, dims, kind, at_least),
                              f"variant long, vector {kind_of}, bar double, host long, wanted array<int>").count()
    return 1 - visits / (blocks.rows.count() * (len(blocks.number) - 1))
