"""Redundancy audit: exact (J9), subsumed (J10) and similar (J11) pairs, pattern
categories (F18) and counts (A9, A10).

Structural duplicates never pair inside a group: entries collapse to clause
classes (sorted distinct trimmed requires / ensures) first.  An exact class
is reported as (representative = earliest entry, member) rows -- linear in
entries however large a class grows.  Subsumption pairs classes by a
set-containment join; the links of their members are counted in
``operators.links``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_stage

# Similar-pair pattern names and their markers.
PATTERNS = ("limb_variants", "incremental_lemmas", "symmetric_variants", "comparison_variants", "other")
INCREMENTAL_MARKERS = ("_01", "_012", "_0123", "_01234")
SYMMETRIC_MARKERS = ("_l_", "_r_", "left", "right")
PAIR_TYPES = ("exact", "subsumes", "similar")


def clause_set(col: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.col(col), lambda x: F.trim(x))))


def spec_classes(entries: DataFrame) -> DataFrame:
    """entry_pos, req_key, ens_key for entries with any spec."""
    k = entries.select("entry_pos", clause_set("requires_clauses").alias("req_key"),
                       clause_set("ensures_clauses").alias("ens_key"))
    return k.where((F.size("req_key") > 0) | (F.size("ens_key") > 0))


def exact_duplicates(entries: DataFrame) -> DataFrame:
    """(pos1 = earliest entry of the class, pos2 = another member)."""
    k = spec_classes(entries)
    reps = k.groupBy("req_key", "ens_key").agg(F.min("entry_pos").alias("pos1"))
    j = k.join(reps, ["req_key", "ens_key"]).where(F.col("entry_pos") != F.col("pos1"))
    return j.select(F.lit("exact").alias("type"), "pos1", F.col("entry_pos").alias("pos2"))


def subsumed_pairs(entries: DataFrame) -> DataFrame:
    """Same ensures set, lemma1's requires a strict subset of lemma2's,
    as (earliest entry, earliest entry) of the two classes.

    A set-containment join: a class is looked up by the rarest of its requires
    clauses (within its ensures set) among the clauses of the others; bits of
    the clauses' hashes and then the sets themselves decide.  A class without
    requires stands under a key that every other one has.
    """
    cls = spec_classes(entries).where(F.size("ens_key") > 0).groupBy("req_key", "ens_key").agg(F.min("entry_pos").alias("rep"))
    bits = F.expr("aggregate(req_key, 0L, (a, x) -> a | shiftleft(1L, CAST(pmod(xxhash64(x), 64) AS INT)))")
    cls = write_stage(cls.select("rep", "req_key", F.md5(F.to_json("ens_key")).alias("ens"), "ens_key", bits.alias("bits")), "classes")
    clauses = cls.select("rep", "ens", F.explode("req_key").alias("clause"))
    often = clauses.groupBy("ens", "clause").agg(F.count(F.lit(1)).alias("n"))
    rarest = clauses.join(often, ["ens", "clause"]).groupBy("rep").agg(F.min(F.struct("n", "clause")).alias("r"))
    weak = cls.join(rarest, "rep", "left").select(
        F.col("rep").alias("pos1"), "ens", "ens_key", F.col("req_key").alias("req1"), F.col("bits").alias("bits1"),
        F.coalesce("r.clause", F.lit("")).alias("clause"))
    keys = F.explode(F.concat(F.array(F.lit("")), F.col("req_key"))).alias("clause")
    strong = cls.where(F.size("req_key") > 0).select(
        F.col("rep").alias("pos2"), "ens", F.col("ens_key").alias("ens_key2"), F.col("req_key").alias("req2"), F.col("bits").alias("bits2"), keys)
    inside = (F.col("bits1").bitwiseAND(F.bitwise_not("bits2")) == 0) & (F.size("req1") < F.size("req2")) & (
        F.size(F.array_except("req1", "req2")) == 0) & (F.col("ens_key") == F.col("ens_key2"))
    # a clause that is the empty string stands under the key of the class without clauses
    found = weak.join(strong, ["ens", "clause"]).where(inside).select(F.lit("subsumes").alias("type"), "pos1", "pos2")
    return found.distinct()


def similar_pairs(neighbours: DataFrame, entries: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Neighbour pairs at or above the threshold, each unordered pair once,
    minus pairs whose clause classes are equal or one of which subsumes the
    other.  Classes are compared pair by pair, so members of a class are
    recognised without a list of structural pairs."""
    p = neighbours.where(F.col("score") >= threshold).select(
        F.least("pos1", "pos2").alias("pos1"), F.greatest("pos1", "pos2").alias("pos2"), "score").groupBy(
        "pos1", "pos2").agg(F.max("score").alias("similarity"))
    k = spec_classes(entries)
    k1 = k.select(F.col("entry_pos").alias("pos1"), F.col("req_key").alias("r1"), F.col("ens_key").alias("e1"))
    k2 = k.select(F.col("entry_pos").alias("pos2"), F.col("req_key").alias("r2"), F.col("ens_key").alias("e2"))
    nested = (F.size(F.array_except("r1", "r2")) == 0) | (F.size(F.array_except("r2", "r1")) == 0)
    same = (F.col("e1") == F.col("e2")) & ((F.col("r1") == F.col("r2")) | ((F.size("e1") > 0) & nested))
    return p.join(k1, "pos1", "left").join(k2, "pos2", "left").where(~F.coalesce(same, F.lit(False))).select(
        F.lit("similar").alias("type"), "pos1", "pos2", "similarity")


def categorize_pair(l1: str = "lemma1", l2: str = "lemma2") -> Column:
    """F18 (similar pairs only; others get null)."""
    a, b = F.col(l1), F.col(l2)
    both = F.concat(a, b)
    any_of = lambda col, ms: F.greatest(*[col.contains(m) for m in ms])
    return (F.when(F.lower(a).contains("limb") & F.lower(b).contains("limb"), F.lit("limb_variants"))
            .when(any_of(a, INCREMENTAL_MARKERS), F.lit("incremental_lemmas"))
            .when(any_of(both, SYMMETRIC_MARKERS), F.lit("symmetric_variants"))
            .when((both.contains("_le") & both.contains("_lt")) | (both.contains("mul_le") & both.contains("mul_lt")),
                  F.lit("comparison_variants"))
            .otherwise(F.lit("other")))


def named_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    e1 = entries.select(F.col("entry_pos").alias("pos1"), F.col("name").alias("lemma1"), F.col("file_path").alias("file1"))
    e2 = entries.select(F.col("entry_pos").alias("pos2"), F.col("name").alias("lemma2"), F.col("file_path").alias("file2"))
    return pairs.join(e1, "pos1").join(e2, "pos2")


def type_counts(pairs: DataFrame) -> DataFrame:
    """Links per type (``n_links`` of class rows), 0 when absent."""
    spark = pairs.sparkSession
    types = spark.createDataFrame([(t,) for t in PAIR_TYPES], "type string")
    g = pairs.groupBy("type").agg(F.sum("n_links").alias("n"))
    return types.join(g, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def pattern_counts(similar_named: DataFrame) -> DataFrame:
    """A10: count per pattern of similar pairs, all five listed."""
    spark = similar_named.sparkSession
    pats = spark.createDataFrame([(p, i) for i, p in enumerate(PATTERNS)], "pattern string, pattern_no int")
    g = similar_named.where(F.col("type") == "similar").groupBy(categorize_pair().alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"))
    return pats.join(g, "pattern", "left").select("pattern", "pattern_no", F.coalesce("n", F.lit(0)).alias("n"))
