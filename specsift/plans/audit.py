"""Duplicate detection (Q10) and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.duplicates import categorize_pair, named_pairs, pattern_counts, similar_pairs, type_counts
from ..operators.links import structural_counts, structural_links
from ..operators.neighbours import nearest
from ..operators.topk import examples_per_group
from ..session import write_stage
from .search import Corpus

COLUMNS = ["type", "pos1", "pos2", "lemma1", "lemma2", "similarity", "n_links", "file1", "file2"]


def detect_duplicates(corpus: Corpus, threshold: float = 0.75, include_similar: bool = False,
                      similar_threshold: float = 0.90, k: int = 10) -> DataFrame:
    """Q10: classes whose members are linked - exact (one class) or subsuming
    (two) - and, on request, similar pairs from each entry's k nearest
    neighbours (>= similar_threshold).

    Output: type, pos1, pos2 (classes by their earliest entries; entries for a
    similar pair), lemma1, lemma2, similarity (best of the links), n_links,
    file1, file2.  With vectors every pair of members must reach ``threshold``
    (cosine, inclusive) to be a link; without, all are.
    """
    if corpus.has_vectors:
        out, _ = structural_links(corpus.entries, corpus.vectors, threshold, corpus.cfg.dims)
    else:
        out = structural_counts(corpus.entries)
    if include_similar and corpus.has_vectors:
        nb = nearest(corpus.vectors, k, "ids", kind="ids", dims=corpus.cfg.dims, at_least=similar_threshold)
        similar = similar_pairs(nb, corpus.entries, similar_threshold).withColumn("n_links", F.lit(1).cast("long"))
        out = out.unionByName(similar)
    return named_pairs(out, corpus.entries).select(*COLUMNS)


def duplicate_members(corpus: Corpus, threshold: float = 0.75) -> DataFrame:
    """One row for each entry with clauses: entry_pos, class_id, and its links
    n_exact, n_subsumes, n_subsumed."""
    return structural_links(corpus.entries, corpus.vectors, threshold, corpus.cfg.dims)[1]


def duplicate_report(pairs: DataFrame, examples: int = 3) -> DataFrame:
    """Q11 as rows: section 'types' (key, n links), 'patterns' (key, n similar
    pairs) and 'examples' (key = pattern, the first pairs, and how many more)."""
    pairs = write_stage(pairs, "pairs")
    sim = pairs.where(F.col("type") == "similar").withColumn("key", categorize_pair())
    ex = examples_per_group(sim, "key", [F.col("pos1"), F.col("pos2")], examples)
    none = lambda kind: F.lit(None).cast(kind)
    head = lambda df, name, key: df.select(
        F.lit(name).alias("section"), F.col(key).alias("key"), F.col("n").cast("long").alias("n"), none("int").alias("example_no"),
        none("long").alias("pos1"), none("long").alias("pos2"), none("long").alias("more"))
    shown = ex.select(F.lit("examples").alias("section"), "key", none("long").alias("n"), "example_no", "pos1", "pos2",
                      F.col("more").cast("long").alias("more"))
    return head(type_counts(pairs), "types", "type").unionByName(head(pattern_counts(pairs), "patterns", "pattern")).unionByName(shown)


def write_duplicate_report(pairs: DataFrame, path: str, threshold: float,
                           similar_threshold: float | None) -> None:
    """``path/header`` holds {threshold, similar_threshold, total} (one row;
    total is the number of links) and ``path/duplicates`` the pairs as JSON
    lines, written by every task in parallel (no single-row collection)."""
    pairs = write_stage(pairs, "pairs")
    total = pairs.agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("total"))
    head = total.select(F.lit(float(threshold)).alias("threshold"), F.lit(similar_threshold).cast("double").alias("similar_threshold"),
                        F.col("total").cast("long"))
    head.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/header")
    pairs.select("type", "lemma1", "lemma2", "similarity", "n_links", "file1", "file2").write.mode("overwrite").json(
        f"{path}/duplicates")
