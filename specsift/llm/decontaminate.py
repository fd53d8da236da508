"""Benchmark decontamination by winnowing.

Texts and benchmark items keep the minimum k-gram hash of every sliding
window of w k-grams (the rightmost on ties), with k + w - 1 words equal to the
shared span that must be found: two texts that share that many consecutive
words share a fingerprint there.  Fingerprints meet in a join on their hash
and each hit is extended word by word around the k-gram, which gives exactly
the shared windows.  Items shorter than a window are matched whole, against
every gram of their length.

A bitmap of fixed size over benchmark hashes lets the scan of the documents
drop fingerprints that cannot match; it only saves shuffle and may fill up.

Defined results: null or wordless texts have no words and no hits; an empty
benchmark hits nothing; a benchmark row without item_id marks words but is
not listed; items with one item_id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .words import ALNUM, grams, mix, split_words

K = 5
BITMAP_BITS = 24

_U = np.uint64


def winnow(g: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Positions of the rightmost minimum of each window of ``width`` hashes;
    ``valid`` marks the window starts to use."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = g[width - 1 : width - 1 + n].copy()
    at = np.full(n, width - 1, dtype=np.int64)
    for t in range(width - 2, -1, -1):
        less = g[t : t + n] < best
        best[less] = g[t : t + n][less]
        at[less] = t
    at += np.arange(n)
    return np.unique(at[valid[:n]])


def _context(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: int, after: int, pad: int) -> np.ndarray:
    """Word hashes ``at - before .. at + after`` (exclusive); ``pad`` outside the text."""
    idx = at[:, None] + np.arange(-before, after)
    out = h[np.clip(idx, 0, max(len(h) - 1, 0))]
    out[(idx < lo[:, None]) | (idx >= hi[:, None])] = pad
    return out


def _short_gram(h: np.ndarray, n: int) -> np.ndarray:
    return mix(grams(h, n) + _U(n))


def _column(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(values)], pa.binary())


def _item_prints(window: int):
    w = window - K + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split_words(batch.column("text"), ALNUM):
                h, first, n = words.hashes(), words.first, words.counts
                doc = words.doc_of()
                end = first[doc + 1] if len(h) else np.zeros(0, np.int64)
                g = grams(h, K)
                at = winnow(g, w, np.arange(len(h)) + window <= end)
                ids = batch.column("item_id").slice(words.rows.start, len(words.rows))
                ctx = _context(h, at, first[doc[at]], first[doc[at] + 1], window - K, window, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[at].view(np.int64)), ids.take(pa.array(doc[at])), pa.array(np.zeros(len(at), np.int32)), _column(ctx)],
                    names=["hash", "item_id", "length", "item"],
                )
                short = np.flatnonzero((n > 0) & (n < window))
                gram = np.array([_short_gram(h[first[d] : first[d + 1]], int(n[d]))[0] for d in short], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)),
                        ids.take(pa.array(short)),
                        pa.array(n[short].astype(np.int32)),
                        pa.array([b""] * len(short), pa.binary()),
                    ],
                    names=["hash", "item_id", "length", "item"],
                )

    return run


_HITS = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("length", pa.int32()), ("doc", pa.binary())]))


def _scan(window: int, lengths: list[int], bitmap):
    w = window - K + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        bits = np.frombuffer(bitmap.value, dtype=np.uint8)

        def known(x: np.ndarray) -> np.ndarray:
            b = (x >> _U(64 - BITMAP_BITS)).astype(np.int64)
            return (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for words in split_words(batch.column("text"), ALNUM):
                h, first, n = words.hashes(), words.first, words.counts
                doc = words.doc_of()
                end = first[doc + 1] if len(h) else np.zeros(0, np.int64)
                place = np.arange(len(h))
                g = grams(h, K)
                at = winnow(g, w, place + window <= end)
                at = at[known(g[at])]
                ctx = _context(h, at, first[doc[at]], first[doc[at] + 1], window - K, window, 0)
                found = [(g[at], at, np.zeros(len(at), np.int32), [c.tobytes() for c in ctx])]
                for length in lengths:
                    s = _short_gram(h, length)
                    at = np.flatnonzero(known(s) & (place[: len(s)] + length <= end[: len(s)]))
                    found.append((s[at], at, np.full(len(at), length, np.int32), [b""] * len(at)))
                hashes, at, size = (np.concatenate([f[i] for f in found]) for i in range(3))
                ctx = [c for f in found for c in f[3]]
                order = np.argsort(doc[at], kind="stable")
                counts = np.bincount(doc[at], minlength=len(n)) if len(at) else np.zeros(len(n), np.int64)
                hits = pa.StructArray.from_arrays(
                    [
                        pa.array(hashes[order].view(np.int64)),
                        pa.array((at - first[doc[at]])[order].astype(np.int32)),
                        pa.array(size[order]),
                        pa.array([ctx[i] for i in order], pa.binary()),
                    ],
                    names=["hash", "at", "length", "doc"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), hits).cast(_HITS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(n))),
                        batch.column("doc_id").slice(words.rows.start, len(words.rows)),
                        pa.array(n.astype(np.int64)),
                        lists,
                    ],
                    names=["row", "doc_id", "n_words", "hits"],
                )
                row += len(n)

    return run


def _extend(window: int):
    before, size = window - K, 2 * window - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                b = batch.slice(low, 4096)
                length = b.column("length").to_numpy(zero_copy_only=False)
                at = b.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
                spans = [(np.flatnonzero(length > 0), at[length > 0], length[length > 0])]
                full = np.flatnonzero(length == 0)
                if len(full):
                    side = lambda c: np.frombuffer(b"".join(b.column(c).take(pa.array(full)).to_pylist()), np.uint64).reshape(-1, size)  # noqa: B023, E731
                    same = side("doc") == side("item")
                    for t in range(before + 1):
                        ok = same[:, t : t + window].all(axis=1)
                        spans.append((full[ok], at[full[ok]] - before + t, np.full(ok.sum(), window)))
                rows, start, n = (np.concatenate([s[i] for s in spans]).astype(np.int64) for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(pa.array(rows)), b.column("item_id").take(pa.array(rows)), pa.array(start), pa.array(start + n)],
                    names=["row", "item_id", "start", "end"],
                )

    return run


def benchmark_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, item_ids) per row of ``docs``.

    n_hit counts words inside any occurrence of ``window`` consecutive words of
    an item (of the whole item if it is shorter); spans are their places as
    (start, end) in words; item_ids are the items with such occurrences.
    """
    spark = docs.sparkSession
    source = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    prints = write_stage(
        source.mapInArrow(_item_prints(window), "hash long, item_id string, length int, item binary").distinct(), "decontaminate-items"
    )
    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    filled = prints.select(slot.alias("slot")).selectExpr("cast(slot div 8 as int) as byte", "shiftleft(1, cast(slot % 8 as int)) as bit")
    bits = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)  # 2 MB at any size of the benchmark
    for r in filled.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["byte"]] = r["bits"]
    lengths = sorted(r["length"] for r in prints.filter("length > 0").select("length").distinct().collect())
    scan = write_stage(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _scan(window, lengths, spark.sparkContext.broadcast(bits.tobytes())),
            "row long, doc_id long, n_words long, hits array<struct<hash: long, at: int, length: int, doc: binary>>",
        ),
        "decontaminate-scan",
    )
    pairs = scan.filter(F.size("hits") > 0).select("row", F.inline("hits")).join(prints, ["hash", "length"])
    spans = pairs.select("row", "item_id", "length", "at", "doc", "item").mapInArrow(
        _extend(window), "row long, item_id string, start long, end long"
    )
    found = spans.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["end"]).alias("to"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n"),
        ),
    )["n"]
    out = scan.select("row", "doc_id", "n_words").join(found.withColumn("n_hit", covered), "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item; rows
    are told apart by doc_id and text (a 64-bit hash of both)."""
    keyed = docs.withColumn("row_key__", F.xxhash64("doc_id", "text"))
    bad = benchmark_hits(keyed, items, id_col="row_key__", **options).filter("n_hit > 0")
    bad = bad.select(F.col("doc_id").alias("row_key__")).distinct()
    return keyed.join(bad, "row_key__", "left_anti").select(docs.columns)
