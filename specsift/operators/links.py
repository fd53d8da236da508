"""Links between members of clause classes (Q10, U3, A9): every pair of entries
whose classes are equal or subsume one another, if their cosine reaches a
threshold - counted, not listed.

Members of a class with equal vectors are one *variant* with a multiplicity.
The variants of a class are dealt into blocks of about ``BLOCK_VARIANTS``; each
pair of blocks of a class pair is a cell, whose task multiplies the two bounded
matrices and adds up, for every variant, the entries linked to one of its own.
A class that holds a third of all rows is many cells.  Rows between tasks are
variants, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .duplicates import spec_classes, subsumed_pairs
from .queries import cells
from .vectors import matrix

BLOCK_VARIANTS = 1024
_CELL = ["type", "c1", "c2", "b1", "b2"]


def class_members(entries: DataFrame) -> DataFrame:
    """entry_pos, class_id (the earliest entry with the same clause sets)."""
    k = spec_classes(entries)
    classes = k.groupBy("req_key", "ens_key").agg(F.min("entry_pos").alias("class_id"))
    return k.join(classes, ["req_key", "ens_key"]).select("entry_pos", "class_id")


def _variants(members: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, variant, ids, m), (entry_pos, class_id, variant)."""
    own = members.join(vectors.select("entry_pos", F.sort_array("ids").alias("ids")), "entry_pos")
    variants = write_stage(own.groupBy("class_id", "ids").agg(
        F.min("entry_pos").alias("variant"), F.count(F.lit(1)).alias("m")), "variants")
    return variants, own.join(variants, ["class_id", "ids"]).select("entry_pos", "class_id", "variant")


def _count_cell(threshold: float, dims: int):
    def rows(key: tuple, side: int, variant: np.ndarray, m: np.ndarray, links: np.ndarray, best: np.ndarray):
        on = links > 0
        n = int(on.sum())
        columns = [pa.array([v] * n, t) for v, t in zip(key[:3], (pa.string(), pa.int64(), pa.int64()))] + [pa.array(np.full(n, side, np.int32)), pa.array(variant[on])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(m[on]), pa.array(links[on]), pa.array(best[on])],
                                          names=["type", "c1", "c2", "side", "variant", "m", "links", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in cells(batches, _CELL):
            t = pa.Table.from_batches(parts)
            v, m, side = t["variant"].to_numpy(), t["m"].to_numpy(), t["side"].to_numpy()
            e = matrix(t["ids"].combine_chunks(), dims, "ids")
            square = (e * e).sum(axis=1)
            a = np.flatnonzero(side == 1)
            own = not (side == 2).any() and key[1] == key[2] and key[3] == key[4]
            b = a if own else np.flatnonzero(side == 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (e[a] @ e[b].T) / np.sqrt(square[a][:, None] * square[b][None, :])
            s[~(s >= threshold)] = -np.inf  # not a number where a vector is zero
            on = (s >= threshold).astype(np.int64)
            if own:  # an entry has no link to itself
                single = (m[a] == 1) & (np.diag(on) > 0)
                s[np.diag_indices(len(a))] = np.where(single, -np.inf, np.diag(s))
                yield rows(key, 1, v[a], m[a], on @ m[a] - np.diag(on), s.max(axis=1, initial=-np.inf))
            else:
                yield rows(key, 1, v[a], m[a], on @ m[b], s.max(axis=1, initial=-np.inf))
                yield rows(key, 2, v[b], m[b], on.T @ m[a], s.max(axis=0, initial=-np.inf))

    return run


def count_links(variants: DataFrame, class_pairs: DataFrame, threshold: float, dims: int) -> DataFrame:
    """For ``class_pairs`` (type, c1, c2; c1 = c2 within a class): type, c1, c2,
    side, variant, m, links (of each of the variant's m entries), best cosine."""
    blocks = variants.groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VARIANTS).cast("int").alias("n"))
    n1, n2 = (blocks.select(F.col("class_id").alias(f"c{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    same = F.col("c1") == F.col("c2")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    grid = class_pairs.join(n1, "c1").join(n2, "c2").select("type", "c1", "c2", "n2", F.explode(to("n1")).alias("b1"))
    grid = grid.select("type", "c1", "c2", "b1", F.explode(to("n2")).alias("b2")).where(~same | (F.col("b1") <= F.col("b2")))
    dealt = variants.join(blocks, "class_id").withColumn("block", F.pmod(F.xxhash64("variant"), F.col("n")).cast("int"))

    def side(i: int) -> DataFrame:
        own = dealt.select(F.col("class_id").alias(f"c{i}"), F.col("block").alias(f"b{i}"), "variant", "ids", "m")
        g = grid if i == 1 else grid.where(~same | (F.col("b1") != F.col("b2")))
        return g.join(own, [f"c{i}", f"b{i}"]).select(*_CELL, F.lit(i).alias("side"), "variant", "ids", "m")

    both = side(1).unionByName(side(2)).repartition(*_CELL).sortWithinPartitions(*_CELL, "side")
    return both.mapInArrow(_count_cell(threshold, dims),
                           "type string, c1 long, c2 long, side int, variant long, m long, links long, best double")


def class_links(found: DataFrame) -> DataFrame:
    """type, pos1, pos2 (classes), similarity (best of their links), n_links."""
    within = F.col("type") == "exact"  # both ends of such a link are counted
    ends = F.sum(F.when(within | (F.col("side") == 1), F.col("m") * F.col("links")).otherwise(0))
    g = found.groupBy("type", "c1", "c2").agg(ends.alias("n"), F.max("best").alias("similarity"))
    return g.select("type", F.col("c1").alias("pos1"), F.col("c2").alias("pos2"), "similarity",
                    F.when(within, F.expr("n div 2")).otherwise(F.col("n")).cast("long").alias("n_links"))


def structural_links(entries: DataFrame, vectors: DataFrame, threshold: float, dims: int) -> tuple[DataFrame, DataFrame]:
    """(class links, members): members has a row for each entry of a class with
    its class and its own links: n_exact, n_subsumes (it is the weaker one),
    n_subsumed."""
    members = write_stage(class_members(entries), "class-members")
    variants, of = _variants(members, vectors)
    own = variants.groupBy("class_id").agg(F.sum("m").alias("n")).where("n > 1")
    exact = own.select(F.lit("exact").alias("type"), F.col("class_id").alias("c1"), F.col("class_id").alias("c2"))
    other = subsumed_pairs(entries).select("type", F.col("pos1").alias("c1"), F.col("pos2").alias("c2"))
    found = write_stage(count_links(variants, exact.unionByName(other), threshold, dims), "links")
    total = lambda kind, side: F.sum(F.when((F.col("type") == kind) & side, F.col("links")).otherwise(0))
    first, second = F.col("side") == 1, F.col("side") == 2
    per = found.groupBy("variant").agg(
        total("exact", F.lit(True)).alias("n_exact"), total("subsumes", first).alias("n_subsumes"),
        total("subsumes", second).alias("n_subsumed"))
    linked = of.join(per, "variant", "left").select("entry_pos", "n_exact", "n_subsumes", "n_subsumed")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_subsumes", "n_subsumed")]
    return class_links(found), members.join(linked, "entry_pos", "left").select("entry_pos", "class_id", *counts)


def structural_counts(entries: DataFrame) -> DataFrame:
    """Class links of a corpus without vectors: every pair of members counts."""
    size = class_members(entries).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double").alias("similarity")
    exact = size.where("n > 1").select(F.lit("exact").alias("type"), F.col("class_id").alias("pos1"),
                                       F.col("class_id").alias("pos2"), none, F.expr("n * (n - 1) div 2").alias("n_links"))
    s1, s2 = (size.select(F.col("class_id").alias(f"pos{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    other = subsumed_pairs(entries).join(s1, "pos1").join(s2, "pos2")
    return exact.unionByName(other.select("type", "pos1", "pos2", none, (F.col("n1") * F.col("n2")).alias("n_links")))
