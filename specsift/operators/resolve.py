"""Definition resolution (J1, A5) and spec attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFINITION_ROLE


def definitions(occurrences: DataFrame, role: int = DEFINITION_ROLE) -> DataFrame:
    """The occurrences that define (the role equals ``role``; not a bit test)."""
    return occurrences.where(F.col("symbol_roles") == role)


def definition_map(occurrences: DataFrame, order_cols: list[str], role: int = DEFINITION_ROLE,
                   symbol_col: str = "symbol", path_col: str = "relative_path") -> DataFrame:
    """J1 pre-pass: per symbol, the file of its LAST definition occurrence and
    the line (start + 1) of its last definition that has a start line.

    Role test is equality (not a bit test).  One shuffle on the symbol; the
    partial aggregation keeps one row per symbol and task before it.
    """
    ordk = F.struct(*order_cols)
    d = definitions(occurrences, role)
    return d.groupBy(F.col(symbol_col).alias("symbol")).agg(
        F.max_by(F.col(path_col), ordk).alias("def_path"),
        F.max_by(F.col("start_line") + 1, F.when(F.col("start_line").isNotNull(), ordk)).alias("def_line"),
    )


def symbol_definition_count(occurrences: DataFrame, role: int = DEFINITION_ROLE,
                            symbol_col: str = "symbol") -> DataFrame:
    """A5: number of distinct symbols with a definition."""
    return definitions(occurrences, role).agg(
        F.countDistinct(symbol_col).alias("defined_symbols"))


def resolve_locations(symbols: DataFrame, defs: DataFrame) -> DataFrame:
    """path = definition path (if non-empty) else signature path; line = definition line."""
    j = symbols.join(defs, "symbol", "left")
    return j.withColumn("file_path", F.coalesce(F.nullif(F.col("def_path"), F.lit("")), F.col("sig_path"))) \
        .withColumn("line_from_dump", F.col("def_line").isNotNull())


def attach_specs(entries: DataFrame, decls: DataFrame, name_col: str = "name") -> DataFrame:
    """Clauses by (file_path, name); parsed line only where none resolved."""
    d = decls.select("file_path", F.col("name").alias("_dn"), F.col("line_number").alias("_parsed_line"),
                     F.col("requires").alias("_req"), F.col("ensures").alias("_ens"))
    j = entries.join(d, (entries["file_path"] == d["file_path"]) & (entries[name_col] == d["_dn"]), "left") \
        .drop(d["file_path"])
    empty = F.array().cast("array<string>")
    return j.withColumn("requires_clauses", F.coalesce("_req", empty)) \
        .withColumn("ensures_clauses", F.coalesce("_ens", empty)) \
        .withColumn("parsed_line", F.col("_parsed_line")) \
        .drop("_dn", "_parsed_line", "_req", "_ens")
