"""Registered source/sink round trips (S2, S3, S4, S5, S7, S8).  Each writes
under the session's checkpoint folder (a fresh sub-folder per call) and reads
the result back with the matching reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import ids_digest
from ..session import ensure_checkpoint_dir
from ..sources import corpus_io as IO
from ..sources import fixtures as fx
from . import oracle as O
from ._reg import register
from .audit import detect_duplicates, write_duplicate_report
from .graph import enrich_graph
from .q_audit import _audit_prelude
from .q_search import _graph_ctes
from .search import build_corpus_index


#: Nodes of a graph object written for ``scan_call_graph``.
GRAPH_NODES = 8192


def _folder(spark: SparkSession, what: str) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{what}-{uuid.uuid4().hex}"


@register("scan_corpus", O.prelude("entries") + """
SELECT entry_pos, name, line_number, array_to_string(requires_clauses, ' AND ') AS requires, source FROM entries""")
def q_scan_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "index-shards")
    IO.write_index_shards(fx.entries(spark, sf), path)
    e = IO.read_index_shards(spark, path)
    return e.select("entry_pos", "name", "line_number", F.array_join("requires_clauses", " AND ").alias("requires"),
                    "source")


@register("scan_source_files", O.prelude("src") + "SELECT file_path, content FROM src")
def q_scan_source_files(spark: SparkSession, sf: str) -> DataFrame:
    """S3: a source tree written file by file, read back by the tree reader."""
    path = _folder(spark, "sources")
    IO.write_source_files(fx.src(spark, sf), path)
    return IO.read_source_files(spark, path)


@register("scan_vectors", O.prelude("entries") + f"""
SELECT entry_pos, {O.ids_digest(O._ops(O.searchable()))} FROM entries""")
def q_scan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "corpus")
    c = build_corpus_index(fx.entries(spark, sf))
    IO.write_corpus(c.entries, path, c.vectors.select("entry_pos", "ids"))
    _, vec = IO.read_corpus(spark, path)
    return vec.select("entry_pos", *ids_digest("ids"))


@register("scan_call_graph", O.prelude("nodes") + "SELECT node_id, display_name, body FROM nodes")
def q_scan_call_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Graph files of a ``nodes`` array, read by byte ranges; ids from the nodes' own text."""
    path = _folder(spark, "graph")
    nodes = fx.nodes(spark, sf)
    objects = max(4, -(-nodes.count() // GRAPH_NODES))
    nodes = nodes.select(F.to_json(F.struct("node_id", "display_name", "body")).alias("v"),
                         F.pmod(F.xxhash64("node_id"), F.lit(objects)).alias("part"))
    text = F.concat(F.lit('{"edges":[["a","b"]],"nodes":['), F.array_join(F.collect_list("v"), ","), F.lit("]}"))
    nodes.groupBy("part").agg(text.alias("v")).select("v").write.mode("overwrite").text(path)
    back = IO.read_call_graph(spark, path)
    return back.select(F.get_json_object("node", "$.node_id").cast("long").alias("node_id"), "display_name", "body")


@register("write_duplicate_report", _audit_prelude() + """
SELECT CAST(0.75 AS DOUBLE) AS threshold, CAST(0.9 AS DOUBLE) AS similar_threshold, CAST(sum(n_links) AS BIGINT) AS total,
  CAST(count(*) AS BIGINT) AS lines FROM named""")
def q_write_duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "report")
    pairs = detect_duplicates(build_corpus_index(fx.entries(spark, sf)), include_similar=True)
    write_duplicate_report(pairs, path, 0.75, 0.9)
    head = spark.read.json(f"{path}/header")
    n = spark.read.json(f"{path}/duplicates").agg(F.count(F.lit(1)).alias("lines"))
    return head.crossJoin(n).select("threshold", "similar_threshold", "total", "lines")


@register("write_enriched_graph", O.prelude("docs", "nodes", extra=_graph_ctes(3)) + """
SELECT n.display_name, CAST(coalesce(s.k, 0) AS INTEGER) AS n_similar, s.top AS top_name
FROM nodes n LEFT JOIN (SELECT node_id, count(*) AS k, arg_min(name, rank) AS top FROM ex GROUP BY node_id) s USING (node_id)""")
def q_write_enriched_graph(spark: SparkSession, sf: str) -> DataFrame:
    src = _folder(spark, "graph-in")
    fx.nodes(spark, sf).select(F.to_json(F.struct("node_id", "display_name", "body")).alias("v")) \
        .write.mode("overwrite").text(src)
    nodes = IO.read_call_graph_lines(spark, src)
    out = _folder(spark, "graph-out")
    IO.write_enriched_graph(enrich_graph(build_corpus_index(fx.docs(spark, sf)), nodes, 3), out)
    back = spark.read.schema("display_name string, similar_lemmas array<struct<name:string>>").json(f"{out}/nodes")
    return back.select("display_name", F.coalesce(F.size("similar_lemmas"), F.lit(0)).cast("int").alias("n_similar"),
                       F.col("similar_lemmas")[0]["name"].alias("top_name"))
