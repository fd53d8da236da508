"""Sequence packing along a space-filling curve.

Each document becomes a hashed bag of words projected to a few dimensions;
the coordinates give a Hilbert key, documents are range-sorted by that key
(ties spread by a hash of the row, so a group of copies can be split), and
each range is packed in curve order into sequences of a fixed length:
neighbours in a sequence are neighbours on the curve.

Documents are cut wherever a sequence is full.  The rest at the end of a
range is cut into sequences of power-of-two lengths, so no padding is needed
at all.  Ranges are packed independently; a sequence id is the range's number
and a running number within it.

Tokens are made once, after the sort, from whole texts (``token_files.encoder``).
The number of ranges follows from the bytes of text.

Defined results: a null or empty text is the end id alone; repeated rows are
packed once each; equal keys stand in the order of a hash of the id, then id,
then text; no rows give no sequences; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import encoder
from .words import SPACED, split_words

DIMENSIONS, BITS = 4, 12
#: Bytes of text of a range, about.
RANGE_BYTES = 128 << 20


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n x dims, below
    2**bits), by bit-wise rotation and reflection of the axes."""
    x = x.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _coordinates(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signed sums of the words' hash bits per text, on a uniform scale."""
    n = np.maximum(np.diff(first), 1)
    out = np.empty((len(first) - 1, DIMENSIONS), dtype=np.int64)
    for d in range(DIMENSIONS):
        sums = np.concatenate([[0], np.cumsum(((h >> np.uint64(d + 7)) & np.uint64(1)).astype(np.int64) * 2 - 1)])
        z = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(n)
        u = 1 / (1 + np.exp(-1.702 * z))  # close to the normal distribution function
        out[:, d] = np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in split_words(batch.column("text"), SPACED):
            key = hilbert_key(_coordinates(words.hashes(), words.first), BITS)
            part = batch.slice(words.rows.start, len(words.rows))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(key)], names=["doc_id", "text", "key"])


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names=_NAMES)


def _pack(length: int, end_id: int, files: tuple, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = encoder(*files)
        sequence = TaskContext.get().partitionId() << 33
        open_, filled, out = [], 0, []
        tail = np.array([end_id], dtype="<u4")

        def piece(doc, start, ids, total, offset):
            raw = ids.tobytes()
            out.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if with_ids else None))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([tokens.ids(text).astype("<u4"), tail])
                at, n = 0, len(ids)
                while at < n:
                    take = min(n - at, length - filled)
                    open_.append((doc, at, ids[at : at + take], n, filled))
                    at, filled = at + take, filled + take
                    if filled == length:
                        for p in open_:
                            piece(*p)
                        open_, filled, sequence = [], 0, sequence + 1
                if len(out) >= 20_000:
                    yield _rows(out)
                    out.clear()
        # the rest: one sequence for each power of two in its length
        room = 0
        for doc, start, ids, total, _ in open_:
            at = 0
            while at < len(ids):
                if not room:
                    size = room = 1 << (filled.bit_length() - 1)
                take = min(room, len(ids) - at)
                piece(doc, start + at, ids[at : at + take], total, size - room)
                at, room, filled = at + take, room - take, filled - take
                if not room:
                    sequence += 1
        if out:
            yield _rows(out)

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    pattern: str | None = None,
    length: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and (``with_ids``) the ids as little-endian uint32.

    ``vocabulary`` is a byte-level BPE file; the string of a special token in a
    text becomes its id.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = source.mapInArrow(_keyed, "doc_id long, text string, key long").withColumn("tie", F.xxhash64("doc_id"))
    size = source.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    ranges = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    ordered = keyed.repartitionByRange(ranges, "key", "tie").sortWithinPartitions("key", "tie", "doc_id", "text")
    return ordered.select("doc_id", "text").mapInArrow(
        _pack(length, end_id, (vocabulary, ranks, pattern), with_ids),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
