"""Spec maintenance: missing-spec filter (P6), reference preference (A4),
fill (J3), fill impact (A11), coverage (A7) and the corpus catalog (A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_specs(req: str = "requires_clauses", ens: str = "ensures_clauses") -> Column:
    return (F.size(req) > 0) | (F.size(ens) > 0)


def missing_specs(req: str = "requires_clauses", ens: str = "ensures_clauses") -> Column:
    """Both clause lists empty."""
    return (F.size(req) == 0) & (F.size(ens) == 0)


def preferred_reference_rows(ref: DataFrame) -> DataFrame:
    """A4: per name, the last row (corpus order) that has specs, else the first row."""
    row = F.struct("requires_clauses", "ensures_clauses", "documentation", "entry_pos")
    g = ref.groupBy("name").agg(
        F.max_by(row, F.when(has_specs(), F.col("entry_pos"))).alias("_spec"),
        F.min_by(row, F.col("entry_pos")).alias("_first"),
    )
    best = F.coalesce("_spec", "_first")
    return g.select(
        "name",
        best["requires_clauses"].alias("ref_requires"),
        best["ensures_clauses"].alias("ref_ensures"),
        best["documentation"].alias("ref_documentation"),
        best["entry_pos"].alias("ref_pos"),
    )


def fill_missing_specs(entries: DataFrame, ref: DataFrame) -> DataFrame:
    """Entries without specs take both lists from a same-name reference row
    that has specs; documentation only when their own is empty.  Path and line
    stay.  Adds ``filled`` (bool).  One row per name on the reference side, so
    the join cannot multiply rows; AQE broadcasts it when small."""
    pref = preferred_reference_rows(ref)
    j = entries.join(pref, "name", "left")
    take = missing_specs() & F.coalesce((F.size("ref_requires") > 0) | (F.size("ref_ensures") > 0), F.lit(False))
    own_doc = F.coalesce("documentation", F.lit(""))
    out = j.select(
        *[c for c in entries.columns if c not in ("requires_clauses", "ensures_clauses", "documentation")],
        F.when(take, F.col("ref_requires")).otherwise(F.col("requires_clauses")).alias("requires_clauses"),
        F.when(take, F.col("ref_ensures")).otherwise(F.col("ensures_clauses")).alias("ensures_clauses"),
        F.when(take & (own_doc == "") & (F.coalesce("ref_documentation", F.lit("")) != ""), F.col("ref_documentation"))
        .otherwise(F.col("documentation")).alias("documentation"),
        take.alias("filled"),
    )
    return out.select(*entries.columns, "filled")


def fill_impact(filled: DataFrame) -> DataFrame:
    """Entries without specs before and after, and how many were filled."""
    return filled.agg(
        F.count_if(F.col("filled") | missing_specs()).alias("missing_before"),
        F.count_if(missing_specs()).alias("missing_after"),
        F.count_if("filled").alias("filled"),
    )


def spec_coverage(entries: DataFrame, group_col: str = "source") -> DataFrame:
    """Per group total / with specs / percent, plus TOTAL when >1 group."""
    r = entries.rollup(group_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has_specs()).alias("with_specs"),
        F.grouping_id().alias("_g"),
    )
    n_groups = r.where(F.col("_g") == 0).agg(F.count(F.lit(1)).alias("_n"))
    r = r.crossJoin(F.broadcast(n_groups)).where((F.col("_g") == 0) | (F.col("_n") > 1))
    return r.select(
        F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(group_col)).alias("index_name"),
        "total", "with_specs",
        F.when(F.col("total") > 0, F.col("with_specs") * 100.0 / F.col("total")).otherwise(F.lit(0.0)).alias("pct"),
    )


def corpus_catalog(projects: DataFrame, entries: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Per configured project, entry count and whether vectors exist
    (projects with no entries are listed with 0)."""
    e = entries.select("source", "entry_pos")
    if vectors is not None:
        e = e.join(vectors.select("entry_pos", F.lit(True).alias("_v")), "entry_pos", "left")
    else:
        e = e.withColumn("_v", F.lit(False))
    g = e.groupBy("source").agg(F.count(F.lit(1)).alias("entry_count"),
                                F.max(F.coalesce("_v", F.lit(False))).alias("has_vectors"))
    j = projects.join(g, projects["name"] == g["source"], "left")
    return j.select(projects["name"].alias("project"),
                    F.coalesce("entry_count", F.lit(0)).alias("entry_count"),
                    F.coalesce("has_vectors", F.lit(False)).alias("has_vectors"))
