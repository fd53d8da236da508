"""Elements of one top-level array of large JSON files, read by many tasks.

A file such as ``{"documents": [{...}, {...}], ...}`` is planned as byte ranges.
Whether a range begins inside a string, and how deep, follows from what stands
before it; this is a prefix scan over small summaries:

1. every range tells, for both possible states at its start, the state at its
   end and the change of depth (quotes behind an odd run of backslashes don't
   count; the run is read back over the range's start);
2. with its state known, every range tells where top-level arrays open and
   close in it, under which key, and how many elements begin in between;
3. every range emits the elements that begin in it, reading on past its end for
   the last one.

The passes are reads of a Python data source whose partitions are the ranges;
only a few numbers for each range pass the driver.  A task holds a stretch of
its range and the element it stands in, however large range and file are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package

RANGE_BYTES = 32 << 20
#: Bytes of a range that a task looks at, and elements it hands on, at once.
STRETCH_BYTES = 1 << 20
_KEY_BYTES = 4096
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


def _open(uri: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    place, path = fs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else (fs.LocalFileSystem(), uri)
    return place.open_input_file(path)


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int
    size: int  # of the file
    inside: int = 0  # at the start: in a string
    depth: int = 0
    first: int = 0  # number of the first element that begins here
    extents: tuple = ()  # (from, to) of the wanted arrays in the file

    def __init__(self, file, begin, end, size, inside=0, depth=0, first=0, extents=()):
        self.file, self.begin, self.end, self.size = file, begin, end, size
        self.inside, self.depth, self.first, self.extents = inside, depth, first, tuple(map(tuple, extents))


def _slashes(handle, at: int) -> int:
    """Backslashes just before ``at``."""
    run = 0
    while at > 0:
        low = max(0, at - _KEY_BYTES)
        piece = handle.read_at(at - low, low)
        kept = len(piece.rstrip(b"\\"))
        run, at = run + len(piece) - kept, low
        if kept:
            break
    return run


class _Bytes:
    """A stretch of a file: which bytes are outside strings, and the depth before each."""

    def __init__(self, raw: np.ndarray, begin: int, slashes: int, inside: int, depth: int):
        self.begin, self.raw = begin, raw
        n = len(raw)
        at = np.arange(n, dtype=np.int32)
        other = np.maximum.accumulate(np.where(raw != 92, at, np.int32(-1 - slashes)))
        before = np.concatenate([np.array([-1 - slashes], dtype=np.int32), other[:-1]])
        quote = (raw == 34) & ((at - 1 - before) % 2 == 0)
        count = np.cumsum(quote, dtype=np.int32)
        self.out = (count - quote) % 2 == inside
        self.step = np.zeros(n, dtype=np.int8)
        self.step[(raw == 123) | (raw == 91)] = 1
        self.step[(raw == 125) | (raw == 93)] = -1
        change = np.where(self.out, self.step, np.int8(0))
        depths = np.cumsum(change, dtype=np.int32) + np.int32(depth)
        self.before = depths - change
        # what the next stretch begins with
        self.slashes = int(n - 1 - other[-1])
        self.inside, self.depth = int(inside ^ (int(count[-1]) & 1)), int(depths[-1])


def _stretches(handle, begin: int, end: int, inside: int, depth: int) -> Iterator[_Bytes]:
    """The bytes of [begin, end) in stretches of at most ``STRETCH_BYTES``."""
    slashes = _slashes(handle, begin)
    for at in range(begin, end, STRETCH_BYTES):
        raw = np.frombuffer(handle.read_at(min(STRETCH_BYTES, end - at), at), dtype=np.uint8)
        b = _Bytes(raw, at, slashes, inside, depth)
        slashes, inside, depth = b.slashes, b.inside, b.depth
        yield b


def _summary(part: Range) -> Iterator[tuple]:
    outside = total = inside = 0
    with _open(part.file) as f:
        for b in _stretches(f, part.begin, part.end, 0, 0):
            outside += int(b.step[b.out].sum(dtype=np.int64))
            total += int(b.step.sum(dtype=np.int64))
            inside = b.inside
    yield part.file, part.begin, inside, outside, total - outside, None


def _events(part: Range) -> Iterator[tuple]:
    """Opens and closes of top-level arrays with the number of elements begun before them here."""
    seen = 0
    with _open(part.file) as f:
        for b in _stretches(f, part.begin, part.end, part.inside, part.depth):
            element = seen + np.cumsum(b.out & (b.before == 2) & (b.step == 1), dtype=np.int64)
            for i in np.flatnonzero(b.out & (((b.raw == 91) & (b.before == 1)) | ((b.raw == 93) & (b.before == 2)))).tolist():
                at, key = b.begin + i, None
                if b.raw[i] == 91:
                    low = max(0, at - _KEY_BYTES)
                    found = _KEY.search(f.read_at(at - low, low))
                    key = json.loads(b'"' + found[1] + b'"') if found else ""
                yield part.file, part.begin, int(b.raw[i] == 91), at, int(element[i - 1]) if i else seen, key
            seen = int(element[-1])
    yield part.file, part.begin, 2, part.end, seen, None


def _texts(part: Range) -> Iterator[bytes]:
    """The wanted elements that begin in the range; the last may end behind it."""
    held: list[bytes] | None = None  # the open element so far
    first = -1  # where it begins
    with _open(part.file) as f:
        for b in _stretches(f, part.begin, part.size, part.inside, part.depth):
            begin = b.out & (b.before == 2) & (b.step == 1)
            at = 0
            for i in np.flatnonzero(begin | (b.out & (b.before == 3) & (b.step == -1))).tolist():
                if begin[i]:
                    first = b.begin + i
                    if first >= part.end:
                        return
                    if any(low < first < high for low, high in part.extents):
                        held, at = [], i
                elif held is not None:
                    yield b"".join([*held, b.raw[at : i + 1].tobytes()])
                    held = None
            if held is not None:
                held.append(b.raw[at:].tobytes())
            elif b.begin + len(b.raw) >= part.end:
                return
    if held is not None:
        raise ValueError(f"{part.file}: an element at byte {first} does not end")


def _elements(part: Range) -> Iterator[pa.RecordBatch]:
    number, texts, size = part.first, [], 0

    def batch() -> pa.RecordBatch:
        pos = pa.array(range(number - len(texts), number), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([part.file] * len(texts), pa.string()), pos, pa.array(texts, pa.binary()).cast(pa.string())],
                                          names=["file", "pos", "value"])

    for text in _texts(part):
        texts.append(text)
        number, size = number + 1, size + len(text)
        if size >= STRETCH_BYTES:
            yield batch()
            texts, size = [], 0
    if texts:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.mode = options["mode"]
        self.ranges = [Range(*r) for r in json.loads(options["plan"])]

    def partitions(self):
        return self.ranges

    def read(self, partition):
        return {"summary": _summary, "events": _events, "elements": _elements}[self.mode](partition)


class JsonArraySource(DataSource):
    @classmethod
    def name(cls):
        return "specsift_json_array"

    def schema(self):
        if self.options["mode"] == "elements":
            return "file string, pos long, value string"
        return "file string, begin long, a int, b long, c long, key string"

    def reader(self, schema):
        return _Reader(dict(self.options))


def _read(spark: SparkSession, mode: str, plan: list[Range]) -> DataFrame:
    rows = [(r.file, r.begin, r.end, r.size, r.inside, r.depth, r.first, r.extents) for r in plan]
    return spark.read.format("specsift_json_array").option("mode", mode).option("plan", json.dumps(rows)).load()


def plan_ranges(spark: SparkSession, path: str, key: str) -> list[Range]:
    """Byte ranges of all files under ``path`` with their states and numbers."""
    files = sorted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect())
    ranges = [Range(f, a, min(a + RANGE_BYTES, n), n) for f, n in files for a in range(0, n, RANGE_BYTES)]
    if not ranges:
        return []
    told = {(r.file, r.begin): r for r in _read(spark, "summary", ranges).collect()}
    inside = depth = 0
    for r in ranges:
        if r.begin == 0:
            inside = depth = 0
        r.inside, r.depth = inside, depth
        t = told[r.file, r.begin]
        depth += t.c if inside else t.b
        inside ^= t.a
    events: dict[tuple, list] = {}
    for e in _read(spark, "events", ranges).collect():
        events.setdefault((e.file, e.begin), []).append(e)
    extents: dict[str, list] = {}
    number, since = 0, None  # elements so far; where the open wanted array began
    for r in ranges:
        if r.begin == 0:
            number, since = 0, None
        r.first, seen = number, 0  # a range's first wanted element
        for e in sorted(events[r.file, r.begin], key=lambda e: (e.b, e.a)):
            if since is not None:
                number += e.c - seen
            seen = e.c
            if e.a == 1 and e.key == key and since is None:
                since = e.b
            elif e.a == 0 and since is not None:
                extents.setdefault(r.file, []).append((since, e.b))
                since = None
        if since is not None and r.end == r.size:
            extents.setdefault(r.file, []).append((since, r.size))
    for r in ranges:
        r.extents = tuple(extents.get(r.file, ()))
    return [r for r in ranges if any(low < r.end and high > r.begin for low, high in r.extents)]


def read_json_array(spark: SparkSession, path: str, key: str) -> DataFrame:
    """file, pos (number in the file's array, from 0) and value (the element's
    text) of all elements of the top-level array ``key`` that are objects or arrays."""
    ship_package(spark)
    spark.dataSource.register(JsonArraySource)
    plan = plan_ranges(spark, path, key)
    return _read(spark, "elements", plan) if plan else spark.createDataFrame([], "file string, pos long, value string")
