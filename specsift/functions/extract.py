"""Declaration and clause extraction from source text.

Batch form of a regex extractor over bounded pieces of text.  A file is cut
into chunks of about ``CHUNK_CHARS`` behind closing braces, which no header
holds; every declaration header in a chunk gets a \\u0001 mark and the chunk
splits into pieces at the marks.  What a piece needs from the text before it
(newlines, braces, declarations) is a prefix scan of two levels: within the
chunk, and over one summary row for each chunk of the file.  A header runs from
its start to the next ``{`` - in its own piece, or (a declaration without a
body) at the end of the run of pieces without one.  No row holds more of a file
than its piece.  The first declaration of a name in a file wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Declaration header and clause keywords.
HEADER = r"((?:pub\s+)?(?:proof\s+)?fn\s+([\p{L}\p{N}_]+)\s*\()"
PROOF_HEADER = r"^(?:pub\s+)?proof\s+fn\b"
MARK = "\u0001"
CHUNK_CHARS = 1 << 16
CLAUSE_END = {
    "requires": ("ensures", "decreases", "recommends"),
    "ensures": ("decreases", "recommends"),
    "decreases": ("requires", "ensures", "recommends"),
}


def clause_pattern(keyword: str) -> str:
    ends = "|".join(CLAUSE_END[keyword])
    return rf"(?s)\b{keyword}\b(.*?)(?:\b(?:{ends})\b|\z)"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clauses(header, keyword: str) -> Column:
    """F16: clause list of ``keyword`` in a header (naive comma split)."""
    h = F.col(header) if isinstance(header, str) else header
    body = F.regexp_extract(h, clause_pattern(keyword), 1)
    body = F.regexp_replace(_strip(body), ",+$", "")
    parts = F.transform(F.split(body, ","), _strip)
    return F.coalesce(F.filter(parts, lambda x: x != F.lit("")), F.array().cast("array<string>"))


def source_chunks(src: DataFrame, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """file_path, chunk_no, chunk: the text in order, cut behind closing braces."""
    cut = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s)(.{{1,{CHUNK_CHARS}}}+[^}}]*+\}}?)"), 1)
    return src.select(F.col(path_col).alias("file_path"), F.posexplode(cut).alias("chunk_no", "chunk"))


def _pieces(chunks: DataFrame) -> DataFrame:
    """Pieces of chunks with what stands before them in the file; the first piece
    of a chunk (no declaration) goes on with the last one of the chunk before."""
    marked = F.regexp_replace("chunk", HEADER, MARK + "$1")
    p = chunks.select("file_path", "chunk_no", F.posexplode(F.split(marked, MARK)).alias("piece_no", "piece"))
    p = p.select(
        "file_path", "chunk_no", "piece_no",
        F.substring_index("piece", "{", 1).alias("head"),
        F.contains("piece", F.lit("{")).cast("int").alias("braces"),
        (F.length("piece") - F.length(F.regexp_replace("piece", "\n", ""))).alias("newlines"),
        (F.col("piece_no") > 0).cast("int").alias("decls"),
        F.regexp_extract("piece", HEADER, 2).alias("name"),
        F.col("piece").rlike(PROOF_HEADER).alias("is_proof"),
    )
    counts = ("braces", "newlines", "decls")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    own = before("file_path", "chunk_no", "piece_no")
    p = p.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{c}_in") for c in counts])
    chunk = p.groupBy("file_path", "chunk_no").agg(*[F.sum(c).alias(c) for c in counts])
    up = before("file_path", "chunk_no")
    chunk = chunk.select("file_path", "chunk_no", F.sum("braces").over(Window.partitionBy("file_path")).alias("all_braces"),
                         *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_up") for c in counts])
    return p.join(chunk, ["file_path", "chunk_no"]).select(
        "file_path", "chunk_no", "piece_no", "head", "name", "is_proof", "braces", "all_braces",
        *[(F.col(f"{c}_in") + F.col(f"{c}_up")).alias(f"{c}_before") for c in counts])


def declarations(src: DataFrame, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """F15 + F16 + F17: one row per (file, declaration name), first one wins.

    Output: file_path, name, line_number, end_line, requires, ensures,
    decreases, signature, is_proof, decl_no.
    """
    p = _pieces(source_chunks(src, path_col, text_col))
    # a run: pieces up to the next brace; the last one of a file may have none
    closed = F.col("braces_before") < F.col("all_braces")
    run = Window.partitionBy("file_path", "braces_before").orderBy("chunk_no", "piece_no").rowsBetween(0, Window.unboundedFollowing)
    text = F.array_join(F.collect_list(F.when(closed, F.col("head"))).over(run), "")
    d = p.select(
        "file_path", "name", "is_proof", "piece_no", (F.col("decls_before") + 1).cast("int").alias("decl_no"),
        (F.col("newlines_before") + 1).cast("int").alias("line_number"), F.when(closed, text).alias("header"),
    ).where("piece_no > 0")
    first = Window.partitionBy("file_path", "name").orderBy("decl_no")
    d = d.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "piece_no")
    hl = F.length("header") - F.length(F.regexp_replace("header", "\n", ""))
    return d.select(
        "file_path", "name", "line_number",
        F.when(F.col("header").isNotNull(), F.col("line_number") + hl).cast("int").alias("end_line"),
        F.when(F.col("header").isNotNull(), clauses("header", "requires")).otherwise(F.array().cast("array<string>")).alias("requires"),
        F.when(F.col("header").isNotNull(), clauses("header", "ensures")).otherwise(F.array().cast("array<string>")).alias("ensures"),
        F.when(F.col("header").isNotNull(), clauses("header", "decreases")).otherwise(F.array().cast("array<string>")).alias("decreases"),
        _strip(F.regexp_replace(F.coalesce("header", F.lit("")), r"\s+", " ")).alias("signature"),
        "is_proof",
        "decl_no",
    )


def extraction_status(requests: DataFrame, src: DataFrame, decls: DataFrame) -> DataFrame:
    """per requested (file_path, name): found / not found / empty file."""
    files = src.select("file_path", (F.coalesce(F.length("content"), F.lit(0)) > 0).alias("_has_text"))
    j = requests.join(files, "file_path", "left").join(
        decls.select("file_path", "name", "line_number"), ["file_path", "name"], "left")
    status = (F.when(~F.coalesce("_has_text", F.lit(False)), F.lit("empty file"))
              .when(F.col("line_number").isNull(), F.lit("Function not found"))
              .otherwise(F.lit("found")))
    return j.select(*requests.columns, "line_number", status.alias("status"))
