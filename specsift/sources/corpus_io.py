"""Corpus, vectors and call-graph readers / writers.

Native corpus form: a parquet dataset partitioned by ``source`` (scans of
one source prune the others) plus a ``vectors`` parquet dataset keyed by
``entry_pos``, and a one-line JSON header.  The reference's single JSON
index ({version, repo_root, lemmas[], has_embeddings}) is read as well.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffles_deleted, write_stage
from .json_array import read_json_array

ENTRY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("documentation", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("requires_clauses", T.ArrayType(T.StringType())),
    T.StructField("ensures_clauses", T.ArrayType(T.StringType())),
    T.StructField("symbol_id", T.StringType()),
    T.StructField("source", T.StringType()),
])
INDEX_JSON = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("repo_root", T.StringType()),
    T.StructField("lemmas", T.ArrayType(ENTRY)),
    T.StructField("has_embeddings", T.BooleanType()),
])
NODE = T.StructType([
    T.StructField("display_name", T.StringType()),
    T.StructField("body", T.StringType()),
])
GRAPH_JSON = T.StructType([T.StructField("nodes", T.ArrayType(NODE))])


def _empty():
    return F.array().cast("array<string>")


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON index per file -> entries (absent lists -> empty, absent source -> project)."""
    e = read_json_array(spark, path, "lemmas").select(F.col("pos").alias("entry_pos"), F.from_json("value", ENTRY).alias("l"))
    return e.select(
        F.col("entry_pos").cast("long"),
        F.col("l.name").alias("name"), F.col("l.file_path").alias("file_path"),
        F.col("l.line_number").alias("line_number"),
        F.coalesce("l.documentation", F.lit("")).alias("documentation"),
        F.coalesce("l.signature", F.lit("")).alias("signature"),
        F.coalesce("l.requires_clauses", _empty()).alias("requires_clauses"),
        F.coalesce("l.ensures_clauses", _empty()).alias("ensures_clauses"),
        F.coalesce("l.symbol_id", F.lit("")).alias("symbol_id"),
        F.coalesce("l.source", F.lit("project")).alias("source"),
    )


def write_corpus(entries: DataFrame, path: str, vectors: DataFrame | None = None, repo_root: str = "") -> None:
    """Entries partitioned by source, vectors beside them, header as JSON."""
    entries.write.mode("overwrite").partitionBy("source").parquet(f"{path}/entries")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    header = {"version": "1.0", "repo_root": repo_root, "has_embeddings": vectors is not None}
    spark = entries.sparkSession
    spark.createDataFrame([header]).coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Entries and (S4) vectors when the header says they exist and they are there."""
    entries = spark.read.parquet(f"{path}/entries")
    header = spark.read.json(f"{path}/header").first()
    vec = None
    if header is not None and header["has_embeddings"] and _exists(spark, f"{path}/vectors"):
        vec = spark.read.parquet(f"{path}/vectors")
    return entries, vec


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_call_graph(spark: SparkSession, path: str) -> DataFrame:
    """{nodes: [...]} -> node_id (position), display_name, body, node (raw JSON
    kept for write-back); a large file is read by as many tasks as byte ranges."""
    nodes = read_json_array(spark, path, "nodes").select(F.col("pos").alias("node_id"), F.col("value").alias("node"))
    parsed = F.from_json("node", NODE)
    return nodes.select("node_id", parsed["display_name"].alias("display_name"), parsed["body"].alias("body"), "node")


@F.pandas_udf(T.StringType())
def _with_similar(node: pd.Series, similar: pd.Series) -> pd.Series:
    """The node object with ``similar_lemmas`` set (replacing an old one)."""
    return pd.Series([json.dumps({**json.loads(n), "similar_lemmas": json.loads(s)}, ensure_ascii=False)
                      for n, s in zip(node, similar)])


@F.pandas_udf(T.StringType())
def _other_keys(graph: pd.Series) -> pd.Series:
    return pd.Series([json.dumps({k: v for k, v in json.loads(g).items() if k not in ("nodes", "edges")},
                                 ensure_ascii=False) for g in graph])


def write_enriched_graph(enriched: DataFrame, path: str, source: str | None = None) -> None:
    """``path/nodes`` holds the nodes as JSON lines in their order;
    ``similar_lemmas`` is set only where hits exist, other nodes stay as read.
    With ``source``, the graph document that ``read_call_graph`` read, its
    edges go to ``path/edges`` (one per line) and its other top-level keys to
    ``path/header``."""
    # written: the two kinds of nodes and the ranges of their order each read it
    enriched = write_stage(enriched.select("node_id", "node", "similar_lemmas"), "enriched")
    hit = F.col("similar_lemmas").isNotNull()
    changed = enriched.where(hit).select("node_id", _with_similar("node", F.to_json("similar_lemmas")).alias("node"))
    out = changed.unionByName(enriched.where(~hit).select("node_id", "node"))
    with shuffles_deleted(enriched.sparkSession):
        out.orderBy("node_id").select("node").write.mode("overwrite").text(f"{path}/nodes")
    if source is not None:
        raw = enriched.sparkSession.read.text(source, wholetext=True)
        edges = F.from_json("value", "struct<edges:array<string>>")["edges"]
        raw.select(F.explode(edges)).write.mode("overwrite").text(f"{path}/edges")
        raw.select(_other_keys("value")).write.mode("overwrite").text(f"{path}/header")


def write_source_files(src: DataFrame, root: str) -> None:
    """(file_path, content) rows as one file each under ``root``, written by the
    tasks; any place that pyarrow can write to.  A path that leaves the root is
    an error."""

    def run(batches):
        from pyarrow import fs

        uri = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root)
        place, top = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root)) if uri else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ".." in path.split("/") or path.startswith("/"):
                    raise ValueError(f"not under the root: {path}")
                place.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with place.open_output_stream(f"{top}/{path}") as out:
                    out.write((text or "").encode())
            yield batch.select([0])

    src.select("file_path", "content").mapInArrow(run, "file_path string").write.format("noop").mode("overwrite").save()


def read_source_files(spark: SparkSession, root: str, pattern: str = "*.rs") -> DataFrame:
    """S3: (file_path relative to root, content), one row per file.

    Files are read whole (``wholetext``), recursively, from any file system.
    Paths are compared without scheme and host and decoded from their URI
    form; a file that does not lie under the root is an error.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(path).toUri().getPath().rstrip("/") + "/"
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
          .text(root, wholetext=True)
          .select(F.col("_metadata.file_path").alias("_uri"), F.col("value").alias("content")))
    bare = F.regexp_replace("_uri", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    full = F.url_decode(F.regexp_replace(bare, "\\+", "%2B"))  # a plus sign in a path is no space
    outside = F.raise_error(F.concat(F.lit("not under the root: "), full)).cast("string")
    rel = F.when(F.startswith(full, F.lit(base)), F.substr(full, F.lit(len(base) + 1))).otherwise(outside)
    return df.select(rel.alias("file_path"), "content")


SHARD_ENTRY = T.StructType([T.StructField("entry_pos", T.LongType())] + ENTRY.fields)
SHARD = T.StructType([T.StructField("lemmas", T.ArrayType(SHARD_ENTRY)) if f.name == "lemmas" else f
                      for f in INDEX_JSON.fields])


def write_index_shards(entries: DataFrame, path: str, shard_size: int = 1000, repo_root: str = "",
                       has_embeddings: bool = False) -> None:
    """The reference's index object, written as bounded shards: one JSON line
    per range of ``shard_size`` positions, every entry with its own position
    (positions may have gaps).  Each shard is built in its own group
    (bounded), never the whole corpus in one document."""
    lemma = F.struct(*[F.col(f.name) for f in SHARD_ENTRY])
    g = entries.groupBy(F.floor(F.col("entry_pos") / shard_size).alias("_shard")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("entry_pos", lemma.alias("l")))), lambda x: x["l"]).alias("lemmas"))
    g.select(F.lit("1.0").alias("version"), F.lit(repo_root).alias("repo_root"), "lemmas",
             F.lit(has_embeddings).alias("has_embeddings")).write.mode("overwrite").json(path)


def read_index_shards(spark: SparkSession, path: str) -> DataFrame:
    """S2 over index shards: every entry carries its position."""
    raw = spark.read.schema(SHARD).json(path)
    e = raw.select(F.explode("lemmas").alias("l"))
    return e.select(
        F.col("l.entry_pos").alias("entry_pos"),
        F.col("l.name").alias("name"), F.col("l.file_path").alias("file_path"),
        F.col("l.line_number").alias("line_number"),
        F.coalesce("l.documentation", F.lit("")).alias("documentation"),
        F.coalesce("l.signature", F.lit("")).alias("signature"),
        F.coalesce("l.requires_clauses", _empty()).alias("requires_clauses"),
        F.coalesce("l.ensures_clauses", _empty()).alias("ensures_clauses"),
        F.coalesce("l.symbol_id", F.lit("")).alias("symbol_id"),
        F.coalesce("l.source", F.lit("project")).alias("source"),
    )


NODE_LINE = T.StructType([T.StructField("node_id", T.LongType())] + NODE.fields)


def read_call_graph_lines(spark: SparkSession, path: str) -> DataFrame:
    """S5 for large graphs: one node object per line with its ``node_id``
    (the raw line is kept for write-back, like ``read_call_graph``)."""
    raw = spark.read.text(path)
    parsed = F.from_json("value", NODE_LINE)
    return raw.select(parsed["node_id"].alias("node_id"), parsed["display_name"].alias("display_name"),
                      parsed["body"].alias("body"), F.col("value").alias("node"))
