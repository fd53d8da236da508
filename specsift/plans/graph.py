"""Call-graph enrichment (J13, F12, J12, A12) and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import node_query_text
from .search import Corpus, exclude_and_cut, fuzzy_search


def enrich_graph(corpus: Corpus, nodes: DataFrame, k: int = 3, flat: bool = False) -> DataFrame:
    """Each named node -> up to k similar entries (fuzzy k+1, minus its own name).

    ``flat=True`` returns the hit rows (node_id, rank, entry_pos, name, score);
    otherwise every node row comes back with ``similar_lemmas``
    array<struct<name, score (3 places), file_path, line_number, signature>>,
    null when the node got no hits (the node stays as it was).
    """
    named = nodes.where(F.coalesce("display_name", F.lit("")) != "")
    q = named.select("node_id", "display_name", node_query_text("display_name", "body").alias("query"))
    hits = fuzzy_search(corpus, q.select("node_id", "query"), k + 1, "node_id", "query")
    hits = hits.join(q.select("node_id", "display_name"), "node_id")
    hits = exclude_and_cut(hits, "node_id", k, F.col("name") == F.col("display_name")).drop("display_name")
    if flat:
        return hits
    e = corpus.entries.select("entry_pos", "file_path", "line_number", "signature")
    h = hits.join(e, "entry_pos")
    per_node = h.groupBy("node_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("rank"), F.col("name"), F.bround("score", 3).alias("score"),
            "file_path", "line_number", "signature")))
        .alias("_s")
    ).select("node_id", F.transform("_s", lambda s: s.dropFields("rank")).alias("similar_lemmas"))
    return nodes.join(per_node, "node_id", "left")


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    """Nodes processed and nodes that received similar entries."""
    return enriched.agg(
        F.count(F.lit(1)).alias("nodes_processed"),
        F.count_if(F.coalesce(F.size("similar_lemmas"), F.lit(0)) > 0).alias("nodes_enriched"),
    )
