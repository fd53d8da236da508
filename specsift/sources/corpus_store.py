"""A versioned corpus of appended parts.

``path/parts/<part>`` holds the rows of one addition with their terms, word runs
and hashed ids, made once when they were added; ``path/manifest/version=N``
lists the parts of version N with the offset that their positions get.  Adding
a corpus writes its own rows and a new manifest: the base is neither read nor
written, an empty addition shows in the written part's row count, and of two
writers of one version the second fails.  Readers union the parts of a version
and shift positions on the way (merge on read); older versions stay readable.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig

_MANIFEST = "part string, source string, offset long, rows long, last long, has_vectors boolean"


@dataclass
class CorpusStore:
    spark: SparkSession
    path: str
    cfg: SearchConfig = SearchConfig()

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        place = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not place.exists(top):
            return []
        found = [s.getPath() for s in place.listStatus(top)]
        done = [p for p in found if place.exists(jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/_SUCCESS"))]
        return sorted(int(p.getName().partition("=")[2]) for p in done)

    def manifest(self, version: int | None = None) -> list:
        """The parts of a version (the newest), in the order they were added."""
        known = self.versions()
        if version is None and not known:
            return []
        at = f"{self.path}/manifest/version={known[-1] if version is None else version}"
        return sorted(self.spark.read.schema(_MANIFEST).json(at).collect(), key=lambda r: r.offset)

    def append(self, entries: DataFrame, with_vectors: bool = True, allow_empty: bool = False) -> int:
        """Adds ``entries`` (positions from 0 in their own order) behind all
        others; gives the new version.  ValueError when there are none."""
        from ..plans.search import _index_columns

        before = self.manifest()
        version = (self.versions() or [0])[-1] + 1
        part = f"{len(before):05d}-{uuid.uuid4().hex}"
        rows = _index_columns(entries, with_vectors, self.cfg)
        rows.write.parquet(f"{self.path}/parts/{part}")
        size = self.spark.read.parquet(f"{self.path}/parts/{part}").agg(
            F.count(F.lit(1)).alias("rows"), F.max("entry_pos").alias("last"), F.min("source").alias("source")).first()
        if not size.rows and not allow_empty:
            raise ValueError("no entries to add")
        offset = max((r.offset + r.last + 1 for r in before if r.rows), default=0)
        listed = [tuple(r) for r in before] + [(part, size.source, offset, size.rows, -1 if size.last is None else size.last, with_vectors)]
        self.spark.createDataFrame(listed, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/version={version}")
        return version

    def _rows(self, version: int | None, columns: list[str]) -> DataFrame:
        parts = [r for r in self.manifest(version) if r.rows]
        if not parts:
            raise ValueError(f"nothing in {self.path}")
        shifted = (F.col("entry_pos") + F.lit(r.offset) for r in parts)
        read = [
            self.spark.read.parquet(f"{self.path}/parts/{r.part}").withColumn("entry_pos", pos).select(*columns)
            for r, pos in zip(parts, shifted)
        ]
        return reduce(DataFrame.unionByName, read)

    def entries(self, version: int | None = None) -> DataFrame:
        return self._rows(version, ["entry_pos", "name", "file_path", "line_number", "documentation", "signature",
                                    "requires_clauses", "ensures_clauses", "symbol_id", "source"])

    def vectors(self, version: int | None = None) -> DataFrame | None:
        """entry_pos, name, ids; None if any part came without (the flag clears)."""
        if not all(r.has_vectors for r in self.manifest(version) if r.rows):
            return None
        return self._rows(version, ["entry_pos", "name", "ids"])

    def corpus(self, version: int | None = None):
        """The searchable corpus of a version: nothing is tokenised again."""
        from ..plans.search import Corpus

        words = self._rows(version, ["entry_pos", "name", "terms", "name_runs", "doc_runs"])
        return Corpus(self.entries(version), words, self.vectors(version), self.cfg)


def add_built_corpus(store: CorpusStore, docs: DataFrame, src: DataFrame, path_prefix: str, source: str) -> int:
    """Q8: builds the corpus under a prefix once, tagged ``source``, and appends
    it; ValueError when the prefix has no entries."""
    from ..plans.build import build_corpus

    new = build_corpus(docs, src, path_prefix, source).drop("line_from_dump")
    try:
        return store.append(new)
    except ValueError:
        raise ValueError(f"no entries found under {path_prefix!r}") from None
