"""Registered build-path queries (S1, P3, P7, J1, A5, F15-F17, F20, J2, Q7,
A6, U1, U2, Q8) with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.encode import hashed_ids, ids_digest
from ..functions.text import searchable_text
from ..operators.resolve import attach_specs, definition_map, symbol_definition_count
from ..sources import fixtures as fx
from ..session import ensure_checkpoint_dir
from ..sources.corpus_store import CorpusStore, add_built_corpus
from ..sources.dump import occurrences_of, read_symbol_dump, symbols_of, write_symbol_dump
from . import oracle as O
from ._reg import register
from .build import (build_corpus, declaration_symbol_filter, line_origin_stats,
                    merge_corpora)

# ---- SQL twins -------------------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clauses_sql(h: str, kw: str) -> str:
    body = f"regexp_replace({_strip(f'regexp_extract({h}, {chr(39)}{X.clause_pattern(kw)}{chr(39)}, 1)')}, ',+$', '')"
    return (f"CASE WHEN {h} IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter(list_transform(string_split({body}, ','), "
            f"lambda x: {_strip('x')}), lambda x: x <> '') END")


DECL_CTES = {
    "dsp": f"""SELECT file_path, content, unnest(ps) AS piece, unnest(generate_series(0, len(ps) - 1)) AS decl_no
      FROM (SELECT file_path, content, string_split(regexp_replace(content, '{X.HEADER}', chr(1) || '\\1', 'g'), chr(1)) AS ps
            FROM src) a""",
    "dsw": """SELECT *, CAST(coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w, 0) AS BIGINT) AS nl_before,
      CAST(coalesce(sum(length(piece)) OVER w, 0) AS BIGINT) AS chars_before FROM dsp
      WINDOW w AS (PARTITION BY file_path ORDER BY decl_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "dsh": f"""SELECT file_path, decl_no, regexp_extract(piece, '{X.HEADER}', 2) AS name,
      CAST(nl_before + 1 AS INTEGER) AS line_number,
      CASE WHEN instr(piece, '{{') > 0 THEN split_part(piece, '{{', 1)
           WHEN instr(substr(content, chars_before + 1), '{{') > 0
           THEN substr(content, chars_before + 1, instr(substr(content, chars_before + 1), '{{') - 1) END AS header,
      regexp_matches(piece, '{X.PROOF_HEADER}') AS is_proof
      FROM dsw WHERE decl_no > 0
      QUALIFY row_number() OVER (PARTITION BY file_path, name ORDER BY decl_no) = 1""",
    "dcl": f"""SELECT file_path, name, line_number,
      CAST(CASE WHEN header IS NOT NULL THEN line_number + length(header) - length(replace(header, chr(10), '')) END AS INTEGER) AS end_line,
      {_clauses_sql('header', 'requires')} AS requires, {_clauses_sql('header', 'ensures')} AS ensures,
      {_clauses_sql('header', 'decreases')} AS decreases,
      {_strip("regexp_replace(coalesce(header, ''), '\\s+', ' ', 'g')")} AS signature, is_proof, decl_no FROM dsh""",
}

DUMP_CTES = {
    "sy": """SELECT file_path AS relative_path, min(entry_pos) OVER (PARTITION BY file_path) AS doc_pos,
      CAST(row_number() OVER (PARTITION BY file_path ORDER BY entry_pos) - 1 AS INTEGER) AS sym_pos,
      CAST(CASE WHEN entry_pos % 9 = 0 THEN 12 ELSE 17 END AS INTEGER) AS kind,
      (CASE WHEN entry_pos % 4 = 0 THEN regexp_replace(name, '^lemma_', '') ELSE name END) || '_' || CAST(entry_pos AS VARCHAR) AS display_name,
      symbol_id AS symbol, documentation,
      CASE WHEN entry_pos % 8 = 0 THEN replace(signature, 'proof ', '') ELSE signature END AS signature,
      file_path AS sig_path FROM entries""",
    "oc": """SELECT 'sym ' || CAST(l_partkey AS VARCHAR) AS symbol,
      'src/' || lower(p_type) || '/' || replace(lower(p_brand),'#','_') || '.rs' AS relative_path,
      l_linenumber AS symbol_roles,
      CASE WHEN l_quantity % 10 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS start_line,
      l_orderkey, l_extendedprice, l_shipdate, l_quantity, l_linenumber
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "odf": """SELECT symbol, arg_max(relative_path, row(l_orderkey, l_extendedprice, l_shipdate, l_quantity, l_linenumber)) AS def_path,
      arg_max(start_line + 1, row(l_orderkey, l_extendedprice, l_shipdate, l_quantity, l_linenumber)) FILTER (WHERE start_line IS NOT NULL) AS def_line
      FROM oc WHERE symbol_roles = 1 GROUP BY symbol""",
}


def _p3_sql(kind: str, name: str, sig: str) -> str:
    from ..config import IndexConfig

    c = IndexConfig()
    names = " OR ".join(f"contains({name}, '{p}')" for p in c.function_prefixes)
    return f"({kind} = {c.function_kind} AND ({names} OR contains(coalesce({sig}, ''), 'proof')))"


def _build_sql(prefix: str, source: str) -> dict[str, str]:
    d = dict(DUMP_CTES)
    d.update(DECL_CTES)
    d["bsy"] = f"SELECT * FROM sy WHERE starts_with(relative_path, '{prefix}') AND {_p3_sql('kind', 'display_name', 'signature')}"
    d["bld"] = f"""SELECT (doc_pos << 24) + sym_pos AS entry_pos, s.display_name AS name,
      coalesce(nullif(f.def_path, ''), s.sig_path) AS file_path,
      CAST(coalesce(f.def_line, dc.line_number) AS INTEGER) AS line_number, s.documentation, s.signature,
      coalesce(dc.requires, CAST([] AS VARCHAR[])) AS requires_clauses, coalesce(dc.ensures, CAST([] AS VARCHAR[])) AS ensures_clauses,
      s.symbol AS symbol_id, '{source}' AS source, f.def_line IS NOT NULL AS line_from_dump
      FROM bsy s LEFT JOIN odf f USING (symbol)
      LEFT JOIN dcl dc ON dc.file_path = coalesce(nullif(f.def_path, ''), s.sig_path) AND dc.name = s.display_name"""
    return d


J_SQL = "array_to_string({}, ' AND ')"

BUILD_OUT = ("entry_pos, name, file_path, line_number, array_to_string(requires_clauses, ' AND ') AS requires, "
             "array_to_string(ensures_clauses, ' AND ') AS ensures, line_from_dump")


def _build_out(df: DataFrame) -> DataFrame:
    return df.select("entry_pos", "name", "file_path", "line_number",
                     F.array_join("requires_clauses", " AND ").alias("requires"),
                     F.array_join("ensures_clauses", " AND ").alias("ensures"), "line_from_dump")


# ---- S1 ------------------------------------------------------------------------------
def _read_dump(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dump-{uuid.uuid4().hex}"
    write_symbol_dump(fx.dump_documents(spark, sf), path)
    return read_symbol_dump(spark, path)


@register("scan_symbol_dump", O.prelude("entries", extra=DUMP_CTES) + """
SELECT doc_pos, sym_pos, relative_path, kind, display_name, symbol, documentation, signature, sig_path FROM sy""")
def q_scan_symbol_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The dump written as JSON files, read back by byte ranges."""
    s = symbols_of(_read_dump(spark, sf))
    return s.select("doc_pos", "sym_pos", "relative_path", "kind", "display_name", "symbol", "documentation",
                    "signature", "sig_path")


@register("scan_symbol_occurrences", O.prelude("entries", extra=DUMP_CTES) + """
SELECT relative_path, symbol, CAST(count(*) AS BIGINT) AS n, CAST(count(start_line) AS BIGINT) AS n_ranged,
  CAST(sum(symbol_roles) AS BIGINT) AS roles FROM oc GROUP BY ALL""")
def q_scan_symbol_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    o = occurrences_of(_read_dump(spark, sf))
    return o.groupBy("relative_path", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("start_line").alias("n_ranged"),
        F.sum("symbol_roles").cast("long").alias("roles"))


# ---- P3 ------------------------------------------------------------------------------
@register("filter_declaration_symbols", O.prelude("entries", extra=DUMP_CTES) + f"""
SELECT doc_pos, sym_pos, display_name FROM sy WHERE {_p3_sql('kind', 'display_name', 'signature')}""")
def q_filter_declaration_symbols(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols_of(fx.dump_documents(spark, sf))
    return s.where(declaration_symbol_filter(F.col("kind"), F.col("display_name"), F.col("signature"))).select(
        "doc_pos", "sym_pos", "display_name")


# ---- J1 / A5 (on the occ view) ---------------------------------------------------------
@register("resolve_definitions", O.prelude("entries", "occ") + """
SELECT e.entry_pos, coalesce(nullif(d.def_path, ''), e.file_path) AS file_path, d.def_line AS line_number
FROM entries e LEFT JOIN (
  SELECT symbol_id, arg_max(doc_path, row(doc_pos, k1, k2, k3, k4)) AS def_path,
         arg_max(start_line + 1, row(doc_pos, k1, k2, k3, k4)) FILTER (WHERE start_line IS NOT NULL) AS def_line
  FROM occ WHERE symbol_roles = 1 GROUP BY symbol_id) d USING (symbol_id)""")
def q_resolve_definitions(spark: SparkSession, sf: str) -> DataFrame:
    defs = definition_map(fx.occ(spark, sf), ["doc_pos", "k1", "k2", "k3", "k4"], symbol_col="symbol_id",
                          path_col="doc_path")
    e = fx.entries(spark, sf)
    j = e.join(defs, e["symbol_id"] == defs["symbol"], "left")
    return j.select("entry_pos", F.coalesce(F.nullif("def_path", F.lit("")), "file_path").alias("file_path"),
                    F.col("def_line").alias("line_number"))


@register("symbol_definition_count", O.prelude("occ") + """
SELECT CAST(count(DISTINCT symbol_id) AS BIGINT) AS defined_symbols FROM occ WHERE symbol_roles = 1""")
def q_symbol_definition_count(spark: SparkSession, sf: str) -> DataFrame:
    return symbol_definition_count(fx.occ(spark, sf), symbol_col="symbol_id")


# ---- F15-F17 / P7 / F20 -------------------------------------------------------------------
_DECL_OUT = ("file_path, name, line_number, end_line, array_to_string(requires, ' AND ') AS requires, "
             "array_to_string(ensures, ' AND ') AS ensures, array_to_string(decreases, ' AND ') AS decreases, "
             "signature, is_proof")


def _decl_out(d: DataFrame) -> DataFrame:
    return d.select("file_path", "name", "line_number", "end_line",
                    F.array_join("requires", " AND ").alias("requires"),
                    F.array_join("ensures", " AND ").alias("ensures"),
                    F.array_join("decreases", " AND ").alias("decreases"), "signature", "is_proof")


@register("extract_declarations", O.prelude("src", extra=DECL_CTES) + f"SELECT {_DECL_OUT} FROM dcl")
def q_extract_declarations(spark: SparkSession, sf: str) -> DataFrame:
    return _decl_out(X.declarations(fx.src(spark, sf)))


@register("filter_proof_declarations", O.prelude("src", extra=DECL_CTES) + f"SELECT {_DECL_OUT} FROM dcl WHERE is_proof")
def q_filter_proof_declarations(spark: SparkSession, sf: str) -> DataFrame:
    return _decl_out(X.declarations(fx.src(spark, sf)).where("is_proof"))


@register("declaration_lines", O.prelude("src", extra=DECL_CTES) + """
SELECT file_path, name, line_number, end_line, CAST(len(requires) AS INTEGER) AS n_requires,
  CAST(len(ensures) AS INTEGER) AS n_ensures FROM dcl""")
def q_declaration_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = X.declarations(fx.src(spark, sf))
    return d.select("file_path", "name", "line_number", "end_line", F.size("requires").alias("n_requires"),
                    F.size("ensures").alias("n_ensures"))


@register("extraction_status", O.prelude("src", "entries", "docs", extra=dict(DECL_CTES, rq="""
  SELECT file_path, name || '_' || CAST(entry_pos AS VARCHAR) AS name FROM entries
  UNION ALL SELECT file_path, name FROM entries UNION ALL SELECT file_path, name FROM docs""")) + """
SELECT rq.file_path, rq.name, dcl.line_number,
  CASE WHEN coalesce(length(s.content), 0) = 0 THEN 'empty file'
       WHEN dcl.line_number IS NULL THEN 'Function not found' ELSE 'found' END AS status
FROM rq LEFT JOIN src s USING (file_path) LEFT JOIN dcl ON dcl.file_path = rq.file_path AND dcl.name = rq.name""")
def q_extraction_status(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    req = e.select("file_path", F.concat("name", F.lit("_"), F.col("entry_pos").cast("string")).alias("name")) \
        .unionByName(e.select("file_path", "name")).unionByName(fx.docs(spark, sf).select("file_path", "name"))
    src = fx.src(spark, sf)
    return X.extraction_status(req, src, X.declarations(src)).select("file_path", "name", "line_number", "status")


# ---- J2 ------------------------------------------------------------------------------------
@register("attach_specs", O.prelude("src", "entries", extra=DECL_CTES) + """
SELECT e.entry_pos, array_to_string(coalesce(d.requires, CAST([] AS VARCHAR[])), ' AND ') AS requires,
  array_to_string(coalesce(d.ensures, CAST([] AS VARCHAR[])), ' AND ') AS ensures, d.line_number AS parsed_line
FROM entries e LEFT JOIN dcl d ON d.file_path = e.file_path AND d.name = e.name || '_' || CAST(e.entry_pos AS VARCHAR)""")
def q_attach_specs(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf).drop("requires_clauses", "ensures_clauses").withColumn(
        "decl_name", F.concat("name", F.lit("_"), F.col("entry_pos").cast("string")))
    j = attach_specs(e, X.declarations(fx.src(spark, sf)), "decl_name")
    return j.select("entry_pos", F.array_join("requires_clauses", " AND ").alias("requires"),
                    F.array_join("ensures_clauses", " AND ").alias("ensures"), "parsed_line")


# ---- Q7 / A6 / U1 / U2 / Q8 ---------------------------------------------------------------------
@register("build_corpus", O.prelude("src", "entries", extra=_build_sql("src/", "project")) + f"SELECT {BUILD_OUT} FROM bld")
def q_build_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _build_out(build_corpus(fx.dump_documents(spark, sf), fx.src(spark, sf), "src/"))


@register("line_origin_stats", O.prelude("src", "entries", extra=_build_sql("src/", "project")) + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE line_from_dump) AS BIGINT) AS from_dump,
  CAST(count(*) FILTER (WHERE NOT line_from_dump) AS BIGINT) AS from_parsing,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE line_from_dump) * CAST(100.0 AS DOUBLE) / count(*) END AS pct_dump,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE NOT line_from_dump) * CAST(100.0 AS DOUBLE) / count(*) END AS pct_parsing FROM bld""")
def q_line_origin_stats(spark: SparkSession, sf: str) -> DataFrame:
    return line_origin_stats(build_corpus(fx.dump_documents(spark, sf), fx.src(spark, sf), "src/"))


_MERGE_SQL = O.prelude("src", "entries", extra=_build_sql("src/small", "reflib")) + """
SELECT entry_pos, name, source FROM entries UNION ALL
SELECT (SELECT max(entry_pos) FROM entries) + 1 + entry_pos, name, source FROM bld"""


@register("merge_corpora", _MERGE_SQL)
def q_merge_corpora(spark: SparkSession, sf: str) -> DataFrame:
    base = fx.entries(spark, sf)
    new = build_corpus(fx.dump_documents(spark, sf), fx.src(spark, sf), "src/small", "reflib").drop("line_from_dump")
    return merge_corpora(base, new).select("entry_pos", "name", "source")


@register("add_reference_corpus", _MERGE_SQL)
def q_add_reference_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: a built corpus appended to a stored one, merged on read."""
    return _grown_store(spark, sf).entries().select("entry_pos", "name", "source")


def _grown_store(spark: SparkSession, sf: str) -> CorpusStore:
    store = CorpusStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    store.append(fx.entries(spark, sf))
    add_built_corpus(store, fx.dump_documents(spark, sf), fx.src(spark, sf), "src/small", "reflib")
    return store


@register("merge_vectors", O.prelude("src", "entries", extra=_build_sql("src/small", "reflib")) + """
SELECT entry_pos, """ + O.ids_digest(O._ops("t")) + """ FROM (
  SELECT entry_pos, """ + O.searchable() + """ AS t FROM entries UNION ALL
  SELECT (SELECT max(entry_pos) FROM entries) + 1 + entry_pos, """ + O.searchable() + """ FROM bld) u""")
def q_merge_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of both parts, each encoded when it was added."""
    return _grown_store(spark, sf).vectors().select("entry_pos", *ids_digest("ids"))


# ---- F16 / F19 / S6+S4 ---------------------------------------------------------------------------
@register("extract_clauses", O.prelude("entries") + f"""
SELECT entry_pos, {J_SQL.format(_clauses_sql("signature || ' requires ' || array_to_string(requires_clauses, ', ') || ' ensures ' || array_to_string(ensures_clauses, ', ')", 'requires'))} AS requires,
  {J_SQL.format(_clauses_sql("signature || ' requires ' || array_to_string(requires_clauses, ', ') || ' ensures ' || array_to_string(ensures_clauses, ', ')", 'ensures'))} AS ensures FROM entries""")
def q_extract_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """F16 on headers rebuilt from every entry (clauses joined with commas)."""
    e = fx.entries(spark, sf)
    h = F.concat_ws(" ", "signature", F.lit("requires"), F.array_join("requires_clauses", ", "), F.lit("ensures"),
                    F.array_join("ensures_clauses", ", "))
    return e.select("entry_pos", F.array_join(X.clauses(h, "requires"), " AND ").alias("requires"),
                    F.array_join(X.clauses(h, "ensures"), " AND ").alias("ensures"))


@register("encode_text", O.prelude("docs", extra={"c": "SELECT * FROM docs", **O.corpus_vector_ctes("c")}) + """
SELECT entry_pos, CAST(count(*) AS INTEGER) AS nnz, CAST(sum(v * v) AS BIGINT) AS norm2, CAST(sum(v) AS BIGINT) AS total
FROM ces GROUP BY entry_pos""")
def q_encode_text(spark: SparkSession, sf: str) -> DataFrame:
    """hashed vector of every document's normalised searchable text."""
    import numpy as np
    import pandas as pd

    from ..functions.encode import dense
    from .search import build_corpus_index

    v = build_corpus_index(fx.docs(spark, sf)).vectors

    def fn(it):
        for pdf in it:
            M = dense(list(pdf["ids"]), 256)
            yield pd.DataFrame({"entry_pos": pdf["entry_pos"], "nnz": (M != 0).sum(axis=1).astype(np.int32),
                                "norm2": (M * M).sum(axis=1).astype(np.int64), "total": M.sum(axis=1).astype(np.int64)})

    return v.mapInPandas(fn, "entry_pos long, nnz int, norm2 long, total long").where("nnz > 0")


@register("write_corpus", O.prelude("entries") + f"""
SELECT entry_pos, name, source, CAST(len(regexp_extract_all(lower({O.searchable()}), {O.W}, 1)) AS INTEGER) AS n_ids
FROM entries""")
def q_write_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """S6 then S4: write entries (partitioned by source) and vectors under the
    session's checkpoint folder, read them back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.corpus_io import read_corpus, write_corpus
    from .search import build_corpus_index

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/corpus-{uuid.uuid4().hex}"
    c = build_corpus_index(fx.entries(spark, sf))
    write_corpus(c.entries, path, c.vectors.select("entry_pos", "ids"))
    e, v = read_corpus(spark, path)
    return e.join(v, "entry_pos").select("entry_pos", "name", "source", F.size("ids").alias("n_ids"))
