"""Cross-site removal of boilerplate lines by distinct-site spread.

Each line's 64-bit hash gathers a HyperLogLog sketch of the sites (column
``source``) it occurs on; sketches merge by aggregation, map side first.
Lines whose estimate is near the threshold get an exact distinct count.
A line on enough sites is boilerplate: all its occurrences go but the first
(smallest doc_id, text hash, line number), so no line is lost altogether.

Lines are compared after trimming white space; lines of fewer than
``min_words`` words (headings, brackets, one-word answers) always stay.

Defined results: a null text stays null with no lines; an empty text has one
line without words; rows alike in doc_id and text are treated alike; a null
site counts as no site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .columns import set_apart

#: Registers of a sketch: 2**8, a standard error of 6.5 %; up to a few dozen
#: sites the sketch is a list and exact.
LOG_REGISTERS = 8
#: Relative distance from the threshold within which sites are counted.
NEAR = 0.25


def _split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(key, sites, first) of the lines on at least ``min_sites`` sites; ``first``
    is the place that stays.  ``lines`` has key, site and place."""
    spread = lines.groupBy("key").agg(
        F.hll_sketch_agg(F.xxhash64("site"), LOG_REGISTERS).alias("sketch"),
        F.count("site").alias("n"),
        F.min("place").alias("first"),
    )
    spread = spread.filter(F.col("n") >= min_sites).select("key", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = write_stage(spread.filter(F.col("estimate") >= min_sites * (1 - NEAR) - 1), "line-spread")
    near = spread.filter(F.col("estimate") <= min_sites * (1 + NEAR) + 1)
    exact = lines.join(near.select("key"), "key", "left_semi").select("key", "site").distinct().groupBy("key").agg(F.count("site").alias("exact"))
    out = spread.join(exact, "key", "left").withColumn("sites", F.coalesce("exact", "estimate"))
    return out.filter(F.col("sites") >= min_sites).select("key", "sites", "first")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 3, min_words: int = 5
) -> DataFrame:
    """``docs`` with the text cleaned, plus n_lines and n_removed (in place of
    columns of these names)."""
    doc = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]
    lines = docs.select(*doc, F.col(site_col).alias("site"), F.posexplode_outer(_split_lines(F.col(text_col))).alias("at", "line"))
    lines = lines.filter("line is not null").withColumn("line", _trimmed(F.col("line")))
    lines = lines.filter(F.size(F.split("line", r"[\x20\x09-\x0D]+")) >= min_words)
    lines = write_stage(
        lines.select("id", "text_hash", "at", "site", F.xxhash64("line").alias("key")), "line-places"
    ).withColumn("place", F.struct("id", "text_hash", "at"))
    drop = lines.join(boilerplate_lines(lines, min_sites).select("key", "first"), "key").filter(~F.col("place").eqNullSafe(F.col("first")))
    drop = drop.groupBy(F.col("id").alias("id__"), F.col("text_hash").alias("text_hash__")).agg(F.collect_set("at").alias("removed__"))
    out = docs.withColumn("hash__", F.xxhash64(text_col))
    out = out.join(drop, F.col(id_col).eqNullSafe(F.col("id__")) & (F.col("hash__") == F.col("text_hash__")), "left")
    split = _split_lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed__"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
    return out.select(
        *[c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")],
        F.when(F.col("removed__").isNull(), F.col(text_col)).otherwise(cleaned).alias(text_col),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed__"), F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with cleaned texts.  A document all of whose words were
    boilerplate of other documents is dropped; a changed text's n_chars is set anew.
    Other columns are kept as they are, whatever their names."""
    names = [options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("site_col", "source"))]
    own, whole = set_apart(docs, [*names, "n_chars"])
    out = dedup_lines(own, **options)
    out = out.filter(~((F.col("n_removed") > 0) & (F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) == "")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return whole(out)
