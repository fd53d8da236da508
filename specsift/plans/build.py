"""Corpus build (Q7) and merges (U1, U2); Q8 is ``sources.corpus_store``.

build: symbol dump -> document filter (P1/P2, symbols only; the definition
pre-pass sees every document) -> declaration-symbol filter (P3) -> definition
resolution (J1) -> clause attachment from parsed sources (J2) -> entries.
Each source file is parsed once (F15-F17) and joined, never re-read per
function.  ``entry_pos`` is (doc_pos << 24) + sym_pos: corpus order, no
global numbering pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.extract import declarations
from ..operators.resolve import attach_specs, definition_map, resolve_locations
from ..sources.dump import occurrences_of, symbols_of

SYM_BITS = 24


def document_filter(path: F.Column, path_prefix: str | None, cfg: IndexConfig = IndexConfig()) -> F.Column:
    """P1 (prefix given, empty means all) else P2 (any keyword contained)."""
    if path_prefix is not None:
        return path.startswith(path_prefix)
    return reduce(lambda a, b: a | b, [path.contains(k) for k in cfg.file_keywords])


def declaration_symbol_filter(kind: F.Column, name: F.Column, signature: F.Column,
                              cfg: IndexConfig = IndexConfig()) -> F.Column:
    """Function kind AND (name contains any prefix OR signature contains 'proof')."""
    by_name = reduce(lambda a, b: a | b, [name.contains(p) for p in cfg.function_prefixes])
    return (kind == cfg.function_kind) & (by_name | F.coalesce(signature, F.lit("")).contains("proof"))


def _entry_pos() -> F.Column:
    """Document and symbol order in one number; too many symbols in one document
    are an error, never equal numbers."""
    full = F.raise_error(F.concat(F.lit(f"more than 2**{SYM_BITS} symbols in "), "relative_path")).cast("long")
    pos = F.shiftleft(F.col("doc_pos"), SYM_BITS) + F.col("sym_pos")
    return F.when(F.col("sym_pos") < 1 << SYM_BITS, pos).otherwise(full)


def build_corpus(docs: DataFrame, src: DataFrame, path_prefix: str | None = None, source: str = "project",
                 cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Q7 -> entries (+ line_from_dump flag for A6)."""
    defs = definition_map(occurrences_of(docs), ["doc_pos", "occ_pos"], cfg.definition_role)
    syms = symbols_of(docs)
    syms = syms.where(document_filter(F.col("relative_path"), path_prefix, cfg))
    syms = syms.where(declaration_symbol_filter(F.col("kind"), F.col("display_name"), F.col("signature"), cfg))
    r = resolve_locations(syms, defs).withColumn("name", F.col("display_name"))
    e = attach_specs(r, declarations(src))
    return e.select(
        _entry_pos().alias("entry_pos"),
        "name", "file_path",
        F.coalesce(F.col("def_line"), F.col("parsed_line")).cast("int").alias("line_number"),
        "documentation", "signature", "requires_clauses", "ensures_clauses",
        F.col("symbol").alias("symbol_id"),
        F.lit(source).alias("source"),
        "line_from_dump",
    )


def line_origin_stats(built: DataFrame) -> DataFrame:
    """How many entry lines came from the dump vs from parsing."""
    return built.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("line_from_dump").alias("from_dump"),
        F.count_if(~F.col("line_from_dump")).alias("from_parsing"),
    ).select("*",
             F.when(F.col("total") > 0, F.col("from_dump") * 100.0 / F.col("total")).alias("pct_dump"),
             F.when(F.col("total") > 0, F.col("from_parsing") * 100.0 / F.col("total")).alias("pct_parsing"))


def merge_corpora(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base rows then new rows, no dedupe; new keys shifted past the base."""
    off = base.agg(F.coalesce(F.max("entry_pos"), F.lit(-1)).alias("_off"))
    shifted = new.crossJoin(F.broadcast(off)).withColumn(
        "entry_pos", F.col("_off") + 1 + F.col("entry_pos")).drop("_off")
    return base.unionByName(shifted.select(*base.columns))


def merge_vectors(base_entries: DataFrame, base_vec: DataFrame | None, new_vec: DataFrame | None) -> DataFrame | None:
    """Stacked only when both sides have vectors (else the flag clears)."""
    if base_vec is None or new_vec is None:
        return None
    off = base_entries.agg(F.coalesce(F.max("entry_pos"), F.lit(-1)).alias("_off"))
    shifted = new_vec.crossJoin(F.broadcast(off)).withColumn(
        "entry_pos", F.col("_off") + 1 + F.col("entry_pos")).drop("_off")
    return base_vec.unionByName(shifted.select(*base_vec.columns))
