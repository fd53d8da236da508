"""Derived views over the driver's parquet tables (Spark side).

These give every operator real rows: ``entries`` (corpus records from
``part``), ``occ`` (symbol occurrences from ``lineitem``), ``src`` (source
files from ``part``), ``docs`` (large text corpus from ``documents``),
``nodes`` (call-graph nodes from ``conversations``), ``vectors``
(``embeddings``) and ``query_batch`` (``benchmark``).  The DuckDB twins
live in ``specsift.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import window_hashes
from ..functions.text import empty_strings
from ..session import write_stage


# Row-identity column of each driver table: a scan with fewer splits than the
# cluster's parallelism is hash-partitioned on it (see ``operators.common.spread``),
# so derived views keep that partitioning under their renamed key.
TABLE_KEYS = {"part": "p_partkey", "documents": "doc_id", "conversations": "conv_id", "benchmark": "item_id",
              "embeddings": "vec_id", "lineitem": "l_orderkey", "pages": "page_id", "labels": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..operators.common import spread

    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = TABLE_KEYS.get(name)
    return spread(df, key) if key else df


def _under(c: str) -> F.Column:
    return F.regexp_replace(F.col(c), " ", "_")


def _file_of_part() -> F.Column:
    return F.concat(
        F.lit("src/"), F.lower("p_type"), F.lit("/"),
        F.regexp_replace(F.lower("p_brand"), "#", "_"), F.lit(".rs"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k4 = F.col("p_partkey") % 4
    req_first = F.concat(F.lit("x > "), (F.col("p_size") % 5).cast("string"))
    ens = F.concat(F.lit("x * "), (F.col("p_size") % 6).cast("string"), F.lit(" >= y"))
    return p.select(
        F.col("p_partkey").alias("entry_pos"),
        F.concat(F.lit("lemma_"), _under("p_name")).alias("name"),
        _file_of_part().alias("file_path"),
        F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("int").alias("line_number"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("About "), F.col("p_name"), F.lit(" of "), F.lower("p_type"))
        ).alias("documentation"),
        F.concat(F.lit("pub proof fn lemma_"), _under("p_name"), F.lit("(x: int, y: int)")).alias("signature"),
        F.when(k4 == 1, F.array(req_first)).when(k4 == 2, F.array(req_first, F.lit("y > 0")))
        .otherwise(empty_strings()).alias("requires_clauses"),
        F.when(k4 == 3, empty_strings()).otherwise(F.array(ens)).alias("ensures_clauses"),
        F.concat(F.lit("sym "), F.col("p_partkey").cast("string")).alias("symbol_id"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("reflib")).otherwise(F.lit("project")).alias("source"),
    )


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("sym "), F.col("l_partkey").cast("string")).alias("symbol_id"),
        F.concat(F.lit("src/doc_"), F.col("l_suppkey").cast("string"), F.lit(".rs")).alias("doc_path"),
        F.col("l_linenumber").alias("symbol_roles"),
        F.when(F.col("l_quantity") % 10 == 0, F.lit(None)).otherwise(F.col("l_quantity").cast("int")).alias("start_line"),
        F.col("l_suppkey").alias("doc_pos"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_extendedprice").alias("k2"),
        F.col("l_shipdate").alias("k3"),
        F.col("l_quantity").alias("k4"),
    )


def src_declarations_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration text per part row, keyed by file and part key."""
    p = table(spark, sf_dir, "part")
    k4 = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    decl = F.concat(
        F.when(F.col("p_partkey") % 5 == 0, F.lit("pub fn lemma_")).otherwise(F.lit("pub proof fn lemma_")),
        _under("p_name"), F.lit("_"), F.col("p_partkey").cast("string"),
        F.lit("(x: int, y: int)\n"),
        F.when(k4.isin(1, 2), F.concat(F.lit("    requires x > "), size, F.lit(", y > 0,\n"))).otherwise(F.lit("")),
        F.when(k4 != 3, F.concat(F.lit("    ensures x * y >= "), size, F.lit(",\n"))).otherwise(F.lit("")),
        F.when(F.col("p_partkey") % 6 == 0, F.lit("    decreases x\n")).otherwise(F.lit("")),
        # some have no body
        F.when(F.col("p_partkey") % 13 == 0, F.lit(";\n")).otherwise(F.lit("{\n}\n")),
    )
    return p.select(_file_of_part().alias("file_path"), F.col("p_partkey"), decl.alias("decl"))


def src(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src_declarations_text(spark, sf_dir)
    return d.groupBy("file_path").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "decl"))), lambda s: s["decl"]), ""
        ).alias("content")
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.col("text"), "\n")
    return d.select(
        F.col("doc_id").alias("entry_pos"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit(".txt")).alias("file_path"),
        F.lit(None).cast("int").alias("line_number"),
        lines.getItem(0).alias("documentation"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("signature"),
        empty_strings().alias("requires_clauses"),
        F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != F.lit("")).alias("ensures_clauses"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("symbol_id"),
        F.col("lang").alias("source"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"),
        F.concat(F.lit("doc_"), (F.col("conv_id") % 100).cast("string")).alias("display_name"),
        F.col("text").alias("body"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("entry_pos"), F.col("embedding").alias("v"))


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def dump_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested symbol dump derived from ``part`` (symbols) and ``lineitem``
    (occurrences), one document per source file of ``src``.

    doc_pos = smallest part key in the file; symbols in part-key order;
    occurrences in (orderkey, price, shipdate, quantity, linenumber) order.
    """
    e = entries(spark, sf_dir)
    pos = F.col("entry_pos")
    sym = F.struct(
        F.when(pos % 9 == 0, F.lit(12)).otherwise(F.lit(17)).cast("int").alias("kind"),
        F.concat(F.when(pos % 4 == 0, F.regexp_replace("name", "^lemma_", "")).otherwise(F.col("name")),
                 F.lit("_"), pos.cast("string")).alias("display_name"),
        F.col("symbol_id").alias("symbol"),
        F.when(F.col("documentation") == "", F.array().cast("array<string>"))
        .otherwise(F.array("documentation")).alias("documentation"),
        F.struct(
            F.when(pos % 8 == 0, F.regexp_replace("signature", "proof ", "")).otherwise(F.col("signature")).alias("text"),
            F.col("file_path").alias("relative_path"),
        ).alias("signature_documentation"),
    )
    sd = e.select("file_path", "entry_pos", sym.alias("s")).groupBy("file_path").agg(
        F.min("entry_pos").alias("doc_pos"),
        F.transform(F.sort_array(F.collect_list(F.struct("entry_pos", "s"))), lambda x: x["s"]).alias("symbols"),
    )
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", _file_of_part().alias("doc_path"))
    occ_s = F.struct(
        F.concat(F.lit("sym "), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_linenumber").alias("symbol_roles"),
        F.when(F.col("l_quantity") % 10 == 0, F.array().cast("array<int>"))
        .otherwise(F.array(F.col("l_quantity").cast("int"))).alias("range"),
    )
    od = li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        "doc_path", F.struct("l_orderkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_linenumber",
                             occ_s.alias("o")).alias("k")
    ).groupBy("doc_path").agg(F.transform(F.sort_array(F.collect_list("k")), lambda x: x["o"]).alias("occurrences"))
    docs = sd.join(od, sd["file_path"] == od["doc_path"], "left")
    return docs.select(
        F.col("doc_pos").cast("long"), F.col("file_path").alias("relative_path"), "symbols",
        F.coalesce("occurrences", F.array().cast(
            "array<struct<symbol:string,symbol_roles:int,range:array<int>>>")).alias("occurrences"),
    )


#: Words of the anchor by which passages and documents meet.
ANCHOR_WORDS = 6


def passage_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) where a document contains a whole benchmark passage.

    A contained passage's inner words (between its first and last space) stand
    in the document as whole space-separated words, so both sides meet in an
    equi-join on the hash of up to ANCHOR_WORDS inner words
    (``functions.encode.window_hashes``); ``contains`` on the whole passage decides.  A passage without inner words has no anchor
    and is compared with every document.
    """
    from functools import reduce

    words = F.split("text", " ", -1)
    bench = table(spark, sf_dir, "benchmark").where(F.length("text") > 0).select(
        "item_id", F.col("text").alias("passage"),
        F.greatest(F.lit(0), F.least(F.lit(ANCHOR_WORDS), F.size(words) - 2)).alias("n"),
        words.alias("w"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    split = docs.select("doc_id", words.alias("w"))
    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())  # at most ANCHOR_WORDS + 1 values
    parts = []
    for n in lengths:
        if n == 0:
            near = bench.where("n = 0").select("item_id", "passage").join(docs, F.col("text").contains(F.col("passage")))
            parts.append(near.select("item_id", "doc_id"))
            continue
        grams = split.where(F.size("w") >= n).select("doc_id", window_hashes(F.col("w"), n).alias("g"))
        inner = bench.where(F.col("n") == n).select("item_id", F.slice("w", 2, n).alias("w"))
        inner = inner.select("item_id", window_hashes(F.col("w"), n).getItem(0).alias("anchor"))
        parts.append(grams.select("doc_id", F.explode("g").alias("anchor")).join(inner, "anchor").select("item_id", "doc_id"))
    if not parts:
        return docs.select(F.lit(0).cast("long").alias("item_id"), "doc_id").limit(0)
    # written, so that its size tells Spark not to shuffle the documents for it
    near = write_stage(reduce(DataFrame.unionByName, parts).distinct(), "near")
    whole = near.join(bench.select("item_id", "passage"), "item_id").join(docs, "doc_id")
    return whole.where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id").distinct()
