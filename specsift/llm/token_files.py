"""Token-id files: concatenated ids with Elias-Fano document boundaries.

Documents are range-sorted by id; every range writes one shard of two files:

* ``shard-NNNNNN.ids``: the ids of its documents one after another, little
  endian, 16 bits (32 if the vocabulary has more than 65 536 ids);
* ``shard-NNNNNN.idx``: ``EFID``, the bytes of an id, the number of documents
  without an id of their own (they come first), then two Elias-Fano sequences:
  the n + 1 boundaries in the id array, and the document ids.

Files are written by the tasks under a name of the attempt and renamed when
complete, so a task that is run again replaces its own file with equal bytes.
A manifest (one row a shard: documents and ids) is written as parquet beside
them.  Readers take the offsets of a range of documents from ``select`` and
read just those ids.

The number of shards follows from the bytes of text, so a task's work does not
grow with the table.  The folder is any place that pyarrow can write to and
that the driver and the executors share.

Defined results: a null or empty text is the end id alone; rows without a
document id come first; rows with equal ids stand in the order of their texts'
hashes and texts, repeated rows each count; an empty table gives no shard and
no rows.  Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .elias_fano import EliasFano

_MAGIC = "<4sBQ"
#: Bytes of text a shard holds about, and documents a reader takes at once.
SHARD_BYTES = 128 << 20
READ_DOCS = 16_384
READ_IDS = 4 << 20

#: Characters of scripts where the rank file's encoder is not used.
_OTHER = re.compile("[^\x00-ɏ]")


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _OTHER.search(text)


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

    ``ranks`` may name the same vocabulary as a rank file.  Its encoder gives
    the same ids faster and serves texts in Latin letters without a special
    token; all others go to ``tokenizers``.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(vocabulary)
        added = self._whole.get_added_tokens_decoder().values()
        self._special = [t.content for t in added]
        self.dtype = "<u2" if self._whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self._fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("whole texts", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self._fast is not None and _latin(text) and not any(s in text for s in self._special):
            return np.array(self._fast.encode_ordinary(text), dtype=self.dtype)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


_loaded: dict[tuple, Encoder] = {}


def encoder(*files) -> Encoder:
    """The encoder of these files, loaded once a worker."""
    if files not in _loaded:
        _loaded[files] = Encoder(*files)
    return _loaded[files]


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else (fs.LocalFileSystem(), uri)


class _Output:
    """A file that appears under its name when it is complete."""

    def __init__(self, files, path: str):
        self._files, self._path, self._part = files, path, f"{path}.{uuid.uuid4().hex}"
        self._out = files.open_output_stream(self._part)
        self.write = self._out.write

    def close(self) -> None:
        self._out.close()
        self._files.move(self._part, self._path)


def _write_shard(folder: str, files: tuple, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode, tail = encoder(*files), None
        place, top = _folder(folder)
        out, lengths, ids, n_null = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, tail = _Output(place, f"{top}/shard-{shard:06d}.ids"), np.array([end_id], encode.dtype).tobytes()
            own = batch.column("doc_id")
            n_null += own.null_count
            ids.append(own.drop_null().to_numpy(zero_copy_only=False))
            sizes = np.empty(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                x = encode.ids(text.as_py())
                sizes[i] = len(x) + 1
                out.write(x.tobytes() + tail)
            lengths.append(sizes)
        if out is None:
            return
        out.close()
        ends = np.cumsum(np.concatenate(lengths))
        index = _Output(place, f"{top}/shard-{shard:06d}.idx")
        index.write(struct.pack(_MAGIC, b"EFID", np.dtype(encode.dtype).itemsize, n_null))
        index.write(EliasFano.encode(np.concatenate([[0], ends])).to_bytes())
        index.write(EliasFano.encode(np.concatenate(ids).astype(np.int64)).to_bytes())
        index.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(ends)], "n_ids": [int(ends[-1])]})

    return run


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    pattern: str | None = None,
    end_id: int = 2,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> str:
    """Writes the shards in ascending order of ids; gives the folder back.

    Without ``folder`` it is a new one in the shared folder of the session.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    ranges = max(4 * spark.sparkContext.defaultParallelism, -(-size // shard_bytes))
    place, top = _folder(folder)
    place.create_dir(f"{top}/ids", recursive=True)
    # the hash lets a range end inside a group of rows with one id
    keyed = source.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    shards = ordered.select("doc_id", "text").mapInArrow(
        _write_shard(f"{folder}/ids", (vocabulary, ranks, pattern), end_id), "shard long, n_docs long, n_ids long"
    )
    shards.write.parquet(f"{folder}/manifest")
    return folder


class Shard:
    """Random access to one shard's documents."""

    def __init__(self, folder: str, shard: int):
        place, top = _folder(folder)
        with place.open_input_stream(f"{top}/shard-{shard:06d}.idx") as f:
            data = f.read()
        magic, self.width, self.n_null = struct.unpack_from(_MAGIC, data)
        if magic != b"EFID":
            raise ValueError(f"shard {shard} in {folder} is not a token index")
        self.bounds, at = EliasFano.from_bytes(data, struct.calcsize(_MAGIC))
        self.doc_ids, _ = EliasFano.from_bytes(data, at)
        self._ids = place.open_input_file(f"{top}/shard-{shard:06d}.ids")

    def __len__(self) -> int:
        return self.bounds.n - 1

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at places first..last-1 of the shard's array."""
        return np.frombuffer(self._ids.read_at((last - first) * self.width, first * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def numbers(self, first: int, last: int) -> pa.Array:
        """Document ids of documents first..last-1."""
        lacking = max(0, min(last, self.n_null) - first)
        have = self.doc_ids.slice(max(0, first - self.n_null), max(0, last - self.n_null))
        return pa.concat_arrays([pa.nulls(lacking, pa.int64()), pa.array(have, pa.int64())])


def _read(folder: str, with_ids: bool):
    def digests(shard: Shard, base: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
        bounds = shard.bounds.slice(first, last + 1)
        at = 0
        while at < last - first:  # runs of documents of a bounded number of ids, or one longer document
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + READ_IDS, side="right")) - 1)
            ids = shard.ids(int(bounds[at]), int(bounds[to]))
            parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[at:to] - bounds[at], bounds[at + 1 : to + 1] - bounds[at])]
            yield pa.RecordBatch.from_arrays(
                [
                    shard.numbers(first + at, first + to),
                    pa.array(base + bounds[at:to]),
                    pa.array(np.diff(bounds[at : to + 1])),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
            )
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                yield from digests(Shard(folder, part["shard"]), part["base"], part["first"], part["last"])

    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 and ids (little-endian uint32; null unless
    ``with_ids``)."""
    # one row a file of the manifest, so its running sum is small whatever the table's size
    shards = sorted(spark.read.schema("shard long, n_docs long, n_ids long").parquet(f"{folder}/manifest").collect())
    parts, base = [], 0
    for shard, n_docs, n_ids in shards:
        parts += [(shard, base, at, min(at + READ_DOCS, n_docs)) for at in range(0, n_docs, READ_DOCS)]
        base += n_ids
    schema = "shard long, base long, first long, last long"
    table = spark.createDataFrame(parts, schema).repartition(max(1, len(parts))) if parts else spark.createDataFrame([], schema)
    return table.mapInArrow(_read(f"{folder}/ids", with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
