"""Symbol dump (S1): nested documents -> symbols / occurrences tables.

A dump is documents[] of {relative_path, symbols[], occurrences[]}.  Two
physical forms are read: JSON objects with a ``documents`` array (order = array
order, or the documents' own ``doc_pos``), each file by as many tasks as it has
byte ranges (``sources.json_array``), or JSON Lines with one document per line
and an explicit ``doc_pos``.  Missing keys read as empty/null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_array import read_json_array

SYMBOL = T.StructType([
    T.StructField("kind", T.IntegerType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("documentation", T.ArrayType(T.StringType())),
    T.StructField("signature_documentation", T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("relative_path", T.StringType()),
    ])),
])
OCCURRENCE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("symbol_roles", T.IntegerType()),
    T.StructField("range", T.ArrayType(T.IntegerType())),
])
DOCUMENT = T.StructType([
    T.StructField("relative_path", T.StringType()),
    T.StructField("symbols", T.ArrayType(SYMBOL)),
    T.StructField("occurrences", T.ArrayType(OCCURRENCE)),
])
DOCUMENT_LINE = T.StructType([T.StructField("doc_pos", T.LongType())] + DOCUMENT.fields)


def read_symbol_dump(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON files -> (doc_pos, relative_path, symbols, occurrences).

    A document without ``doc_pos`` has its number in the array; several files
    need their documents' own.
    """
    raw = read_json_array(spark, path, "documents").select("pos", F.from_json("value", DOCUMENT_LINE).alias("d"))
    return raw.select(
        F.coalesce("d.doc_pos", "pos").alias("doc_pos"), F.coalesce("d.relative_path", F.lit("")).alias("relative_path"),
        F.col("d.symbols").alias("symbols"), F.col("d.occurrences").alias("occurrences"))


def write_symbol_dump(docs: DataFrame, path: str) -> None:
    """Documents (with their doc_pos) as JSON objects with a ``documents`` array,
    one for each document and line: no object holds more than one document."""
    text = F.concat(F.lit('{"documents":['), F.to_json(F.struct(*docs.columns)), F.lit("]}"))
    docs.select(text).write.mode("overwrite").text(path)


def read_symbol_dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, one document per line carrying its ``doc_pos``."""
    return spark.read.schema(DOCUMENT_LINE).json(path).select(
        "doc_pos", F.coalesce("relative_path", F.lit("")).alias("relative_path"), "symbols", "occurrences")


def symbols_of(docs: DataFrame) -> DataFrame:
    s = docs.select("doc_pos", "relative_path", F.posexplode("symbols").alias("sym_pos", "s"))
    sig = F.col("s.signature_documentation")
    return s.select(
        "doc_pos", "relative_path", "sym_pos",
        F.col("s.kind").alias("kind"),
        F.coalesce("s.display_name", F.lit("")).alias("display_name"),
        F.coalesce("s.symbol", F.lit("")).alias("symbol"),
        F.array_join(F.coalesce("s.documentation", F.array().cast("array<string>")), " ").alias("documentation"),
        F.coalesce(sig["text"], F.lit("")).alias("signature"),
        # absent signature path falls back to the document path; present-but-empty stays empty
        F.when(sig.isNull() | sig["relative_path"].isNull(), F.col("relative_path"))
        .otherwise(sig["relative_path"]).alias("sig_path"),
    )


def occurrences_of(docs: DataFrame) -> DataFrame:
    o = docs.select("doc_pos", "relative_path", F.posexplode("occurrences").alias("occ_pos", "o"))
    return o.select(
        "doc_pos", "relative_path", "occ_pos",
        F.coalesce("o.symbol", F.lit("")).alias("symbol"),
        F.coalesce("o.symbol_roles", F.lit(0)).alias("symbol_roles"),
        F.get(F.col("o.range"), 0).alias("start_line"),
    )
