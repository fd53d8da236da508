"""Registered scalar-function and filter queries (F1-F14, P1-P6) with oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import text as T
from ..operators.keyword import keyword_hits, keyword_index
from ..operators.resolve import definitions
from ..operators.specs import missing_specs
from ..sources import fixtures as fx
from . import oracle as O
from ._reg import register
from .build import document_filter


# RE2 (DuckDB) has ASCII-only \b and no look-around; Java's \b (like the
# reference's) treats any Unicode letter or digit as a word character.  The
# oracle spells the boundary out: an explicit non-word group, replaced twice
# so matches that share one separator are all caught.
NW = r"[^\p{L}\p{Nd}_]"


def _word_sub(x: str, word: str, rep: str) -> str:
    def one(y: str) -> str:
        return f"regexp_replace({y}, '(^|{NW})(?i:{word})({NW}|$)', '\\1' || {rep} || '\\2', 'g')"
    return one(one(x))


def _ops_sql(x: str) -> str:
    out = x
    for word, rep in T.OPERATOR_REWRITES:
        out = _word_sub(out, word, f"'{rep}'")
    return out


def _vars_sql(x: str) -> str:
    doubled = f"regexp_replace({x}, '({NW})', '\\1\\1', 'g')"
    found = (f"regexp_extract_all({doubled}, '(?:^|{NW})([a-zA-Z])(?:\\s*[*+\\-/<>=]|\\s+(?i:if|then)(?:{NW}|$))', 1)")
    vs = f"list_sort(list_distinct(list_transform({found}, lambda z: lower(z))))"
    sub = _word_sub("acc", "' || s.v || '", "'var' || CAST(s.i AS VARCHAR)")
    return (f"list_reduce(list_transform({vs}, lambda v, i: struct_pack(v := v, i := i)), "
            f"lambda acc, s: {sub}, {x})")


def normalize_sql(x: str) -> str:
    return _vars_sql(_ops_sql(x))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def variations_list_sql(q: str) -> str:
    """The six candidate variations (NULL when absent), in reference order."""
    it, bi = T.IF_THEN, T.BACKWARD_IF
    cond1 = _strip_sql(f"regexp_extract({q}, '{it}', 1)")
    concl1 = _strip_sql(f"regexp_extract({q}, '{it}', 2)")
    concl2 = _strip_sql(f"regexp_extract({q}, '{bi}', 1)")
    cond2 = _strip_sql(f"regexp_extract({q}, '{bi}', 2)")
    back = f"(regexp_matches({q}, '{bi}') AND NOT contains(lower({q}), 'then'))"
    parts = f"string_split_regex({cond2}, '{T.AND_SPLIT}')"
    two = f"({back} AND contains(lower({cond2}), ' and ') AND len({parts}) = 2)"
    swapped = f"({parts}[2] || ' and ' || {parts}[1])"
    return f"""list_value({q},
      CASE WHEN contains(lower({q}), 'mod') AND NOT contains({q}, '%') THEN replace({q}, 'mod', '%')
           WHEN contains({q}, '%') AND NOT contains(lower({q}), 'mod') THEN replace({q}, '%', 'mod') END,
      CASE WHEN regexp_matches({q}, '{it}') THEN {concl1} || ' if ' || {cond1} END,
      CASE WHEN {back} THEN 'if ' || {cond2} || ' then ' || {concl2} END,
      CASE WHEN {two} THEN {concl2} || ' if ' || {swapped} END,
      CASE WHEN {two} THEN 'if ' || {swapped} || ' then ' || {concl2} END)"""


# ---- F1 / F6 --------------------------------------------------------------
@register("searchable_text", O.prelude("entries") + f"""
SELECT entry_pos, {O.searchable()} AS text, {_ops_sql(O.searchable())} AS text_norm FROM entries""")
def q_searchable_text(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    args = ("name", "documentation", "signature", "requires_clauses", "ensures_clauses")
    return e.select("entry_pos", T.searchable_text(*args).alias("text"),
                    T.searchable_text(*args, normalize=True).alias("text_norm"))


# ---- F2 --------------------------------------------------------------------
@register("plain_embedding_text", O.prelude("entries") + """
SELECT entry_pos, concat_ws(' ', name, nullif(documentation, ''), nullif(signature, ''),
  CASE WHEN len(requires_clauses) > 0 THEN array_to_string(requires_clauses, ' ') END,
  CASE WHEN len(ensures_clauses) > 0 THEN array_to_string(ensures_clauses, ' ') END) AS text
FROM entries""")
def q_plain_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    return e.select("entry_pos", T.plain_embedding_text(
        "name", "documentation", "signature", "requires_clauses", "ensures_clauses").alias("text"))


# ---- F3 --------------------------------------------------------------------
def _card_sql() -> str:
    def bullets(col: str, title: str) -> str:
        return (f"CASE WHEN len({col}) > 0 THEN '   {T.CARD_CHECK} {title}:' || chr(10) || "
                f"array_to_string(list_transform({col}, lambda x: '      {T.CARD_BULLET} ' || trim(x)), chr(10)) END")
    return f"""concat_ws(chr(10),
      '{T.CARD_TITLE_ICON} ' || name || CASE WHEN source <> '{T.DEFAULT_SOURCE}' THEN ' (' || source || ')' ELSE '' END,
      '   ' || CASE WHEN source = '{T.STDLIB_SOURCE}' THEN '{T.CARD_STDLIB_ICON}' ELSE '{T.CARD_FILE_ICON}' END || ' ' || file_path
        || CASE WHEN coalesce(line_number, 0) <> 0 THEN ':' || CAST(line_number AS VARCHAR) ELSE '' END,
      CASE WHEN coalesce(documentation, '') <> '' THEN '   {T.CARD_DOC_ICON} ' || documentation END,
      '   {T.CARD_SIG_ICON}  ' || signature,
      {bullets('requires_clauses', 'requires')},
      {bullets('ensures_clauses', 'ensures')})"""


@register("display_card", O.prelude("entries") + f"SELECT entry_pos, {_card_sql()} AS card FROM entries")
def q_display_card(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    return e.select("entry_pos", T.display_card(
        "name", "file_path", "line_number", "documentation", "signature",
        "requires_clauses", "ensures_clauses", "source").alias("card"))


# ---- F4 --------------------------------------------------------------------
# Example per-source repository settings (a small config table, broadcast).
REPOS = (
    ("project", "https://example.org/acme/project", "main", ""),
    ("reflib", "https://example.org/acme/reflib", "stable", "src/"),
)
_REPOS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in REPOS) + ") t(source, url, branch, path_prefix)"


@register("permalink", O.prelude("entries", extra={"repos": _REPOS_SQL}) + """
SELECT e.entry_pos, CASE WHEN coalesce(e.file_path, '') <> '' THEN
  r.url || '/blob/' || r.branch || '/' ||
  CASE WHEN r.path_prefix <> '' AND NOT starts_with(e.file_path, r.path_prefix) THEN r.path_prefix || e.file_path ELSE e.file_path END
  || CASE WHEN coalesce(e.line_number, 0) <> 0 THEN '#L' || CAST(e.line_number AS VARCHAR) ELSE '' END END AS url
FROM entries e JOIN repos r USING (source)""")
def q_permalink(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    repos = spark.createDataFrame(list(REPOS), "source string, url string, branch string, path_prefix string")
    j = e.join(F.broadcast(repos), "source")
    return j.select("entry_pos", T.permalink("url", "branch", "path_prefix", "file_path", "line_number").alias("url"))


# ---- F6 / F7 / F8 / F9 over the query batch --------------------------------
@register("normalize_operators", O.prelude("query_batch") + f"""
SELECT query_id, {_ops_sql('query')} AS text FROM query_batch""")
def q_normalize_operators(spark: SparkSession, sf: str) -> DataFrame:
    return fx.query_batch(spark, sf).select("query_id", T.normalize_operators("query").alias("text"))


@register("normalize_variables", O.prelude("nodes") + f"""
SELECT node_id, {_vars_sql('body')} AS text FROM nodes""")
def q_normalize_variables(spark: SparkSession, sf: str) -> DataFrame:
    return fx.nodes(spark, sf).select("node_id", T.normalize_variables("body").alias("text"))


@register("normalize_query", O.prelude("query_batch") + f"""
SELECT query_id, {normalize_sql('query')} AS text FROM query_batch""")
def q_normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    return fx.query_batch(spark, sf).select("query_id", T.normalize_query("query").alias("text"))


def variations_sql(source: str, key: str, text_sql: str) -> str:
    """CTE body: (key, var_pos, variation), distinct, first position kept (U4)."""
    return f"""SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY p) - 1 AS INTEGER) AS var_pos, variation
    FROM (SELECT {key}, variation, min(p) AS p FROM (
      SELECT {key}, unnest(vs) AS variation, unnest(generate_series(1, len(vs))) AS p
      FROM (SELECT {key}, {variations_list_sql('nq')} AS vs FROM (SELECT {key}, {text_sql} AS nq FROM {source}) a) b) c
    WHERE variation IS NOT NULL GROUP BY ALL) d"""


@register("query_variations", O.prelude("query_batch", "nodes") + f"""
SELECT query_id, var_pos, variation FROM ({variations_sql('query_batch', 'query_id', normalize_sql('query'))}) v
UNION ALL
SELECT node_id, var_pos, variation FROM ({variations_sql('nodes', 'node_id', normalize_sql('body'))}) w""")
def q_query_variations(spark: SparkSession, sf: str) -> DataFrame:
    def var_rows(df: DataFrame, key: str, col: str) -> DataFrame:
        return df.select(key, F.posexplode(T.query_variations(T.normalize_query(col))).alias("var_pos", "variation")) \
            .withColumnRenamed(key, "query_id")
    qb = var_rows(fx.query_batch(spark, sf), "query_id", "query")
    nd = var_rows(fx.nodes(spark, sf), "node_id", "body")
    return qb.unionByName(nd)


# ---- F10 / F11 ---------------------------------------------------------------
@register("distinct_terms", O.prelude("query_batch") + f"""
SELECT query_id, CAST(len(t) AS INTEGER) AS n_terms, array_to_string(list_sort(t), ' ') AS terms_sorted
FROM (SELECT query_id, list_distinct(regexp_extract_all(lower(query), {O.W}, 1)) AS t FROM query_batch) x""")
def q_distinct_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = T.terms("query")
    return fx.query_batch(spark, sf).select(
        "query_id", F.size(t).alias("n_terms"), F.array_join(F.array_sort(t), " ").alias("terms_sorted"))


@register("substring_term_hits", O.prelude("query_batch", "entries") + f"""
SELECT query_id, entry_pos, CAST(count(*) FILTER (WHERE instr(lower(name), term) > 0) AS BIGINT) AS name_hits,
  CAST(count(*) FILTER (WHERE instr(lower(documentation), term) > 0) AS BIGINT) AS doc_hits
FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), {O.W}, 1)) AS term FROM query_batch) q
JOIN entries e ON instr(lower(e.name), q.term) > 0 OR instr(lower(e.documentation), q.term) > 0
GROUP BY ALL""")
def q_substring_term_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = keyword_hits(keyword_index(fx.entries(spark, sf)), fx.query_batch(spark, sf))
    return hits.where("nm + dc > 0").select("query_id", "entry_pos", F.col("nm").alias("name_hits"), F.col("dc").alias("doc_hits"))


# ---- F12 / F13 / F14 -----------------------------------------------------------
@register("node_query_text", O.prelude("nodes") + """
SELECT node_id, CASE WHEN coalesce(body, '') <> '' THEN display_name || ' ' ||
  array_to_string(string_split(body, chr(10))[1:5], ' ') ELSE display_name END AS query_text
FROM nodes WHERE coalesce(display_name, '') <> ''""")
def q_node_query_text(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.nodes(spark, sf).where(F.coalesce("display_name", F.lit("")) != "")
    return n.select("node_id", T.node_query_text("display_name", "body").alias("query_text"))


@register("join_documentation", O.prelude("docs") + """
SELECT entry_pos, array_to_string(coalesce(ensures_clauses, CAST([] AS VARCHAR[])), ' ') AS documentation FROM docs""")
def q_join_documentation(spark: SparkSession, sf: str) -> DataFrame:
    return fx.docs(spark, sf).select("entry_pos", T.join_documentation("ensures_clauses").alias("documentation"))


def _size_sql(x: str) -> str:
    cases = []
    for i, unit in enumerate(T.SIZE_UNITS):
        shown = f"printf('%.1f', round_even(CAST({x} AS DOUBLE) / {float(1024 ** i)}, 1)) || ' {unit}'"
        if i < len(T.SIZE_UNITS) - 1:
            cases.append(f"WHEN CAST({x} AS DOUBLE) / {float(1024 ** i)} < 1024.0 THEN {shown}")
        else:
            cases.append(f"ELSE {shown}")
    return "CASE " + " ".join(cases) + " END"


@register("human_size", f"""
SELECT doc_id, n_bytes, {_size_sql('n_bytes')} AS size FROM (
  SELECT doc_id, CAST(strlen(text) AS BIGINT) * CAST(pow(1024, doc_id % 5) AS BIGINT) AS n_bytes FROM documents) d""")
def q_human_size(spark: SparkSession, sf: str) -> DataFrame:
    # each document's byte size, scaled by 1024^(doc_id mod 5) so every unit occurs
    d = fx.table(spark, sf, "documents").select(
        "doc_id", F.expr("shiftleft(CAST(octet_length(text) AS BIGINT), CAST(doc_id % 5 * 10 AS INT))").alias("n_bytes"))
    return d.select("doc_id", "n_bytes", T.human_size("n_bytes").alias("size"))


# ---- P1-P6 ---------------------------------------------------------------------
@register("filter_path_prefix", O.prelude("entries") + """
SELECT entry_pos, file_path FROM entries WHERE starts_with(file_path, 'src/small')""")
def q_filter_path_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return fx.entries(spark, sf).where(document_filter(F.col("file_path"), "src/small")).select("entry_pos", "file_path")


PATH_KEYWORDS = ("brand_1", "medium")


@register("filter_path_keywords", O.prelude("entries") + "SELECT entry_pos, file_path FROM entries WHERE "
          + " OR ".join(f"contains(file_path, '{k}')" for k in PATH_KEYWORDS))
def q_filter_path_keywords(spark: SparkSession, sf: str) -> DataFrame:
    kept = document_filter(F.col("file_path"), None, IndexConfig(file_keywords=PATH_KEYWORDS))
    return fx.entries(spark, sf).where(kept).select("entry_pos", "file_path")


@register("filter_definitions", O.prelude("occ") + """
SELECT symbol_id, doc_path, start_line, doc_pos, k1, k2, k4 FROM occ WHERE symbol_roles = 1""")
def q_filter_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return definitions(fx.occ(spark, sf)).select(
        "symbol_id", "doc_path", "start_line", "doc_pos", "k1", "k2", "k4")


@register("filter_missing_specs", O.prelude("entries") + """
SELECT entry_pos, name, source FROM entries WHERE len(requires_clauses) = 0 AND len(ensures_clauses) = 0""")
def q_filter_missing_specs(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    return e.where(missing_specs()).select("entry_pos", "name", "source")
