"""Registered spec-maintenance, duplicate-audit and evaluation queries
(A4, J3, A11, Q9, A7, A8, J8-J11, U3, Q10, F18, A9, A10, W3, Q11, W4, A13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import ids_digest
from ..operators.duplicates import (PATTERNS, categorize_pair, exact_duplicates, pattern_counts, similar_pairs,
                                    subsumed_pairs, type_counts)
from ..operators.neighbours import nearest
from ..operators.specs import corpus_catalog, fill_impact, fill_missing_specs, preferred_reference_rows, spec_coverage
from ..operators.topk import examples_per_group
from ..session import write_stage
from ..sources import fixtures as fx
from . import oracle as O
from ._reg import register
from .audit import detect_duplicates, duplicate_members, duplicate_report
from .evaluate import retrieval_eval
from .maintenance import fill_specs_job
from .search import build_corpus_index, fuzzy_search

J = "array_to_string({0}, ' AND ')"


def _joined(c: str) -> F.Column:
    return F.array_join(c, " AND ")


# ---- A4 / J3 / A11 / Q9 -----------------------------------------------------------------------
_PREF = """SELECT name, coalesce(max(entry_pos) FILTER (WHERE len(requires_clauses) > 0 OR len(ensures_clauses) > 0),
    min(entry_pos)) AS ref_pos FROM entries WHERE source = 'reflib' GROUP BY name"""
_FILL = """SELECT t.entry_pos, t.name,
    CASE WHEN fill THEN r.requires_clauses ELSE t.requires_clauses END AS requires_clauses,
    CASE WHEN fill THEN r.ensures_clauses ELSE t.ensures_clauses END AS ensures_clauses,
    CASE WHEN fill AND coalesce(t.documentation, '') = '' AND coalesce(r.documentation, '') <> '' THEN r.documentation
         ELSE t.documentation END AS documentation, t.signature, coalesce(fill, false) AS filled
  FROM (SELECT e.*, (len(e.requires_clauses) = 0 AND len(e.ensures_clauses) = 0
                     AND (len(r.requires_clauses) > 0 OR len(r.ensures_clauses) > 0)) AS fill, p.ref_pos
        FROM entries e LEFT JOIN pref p USING (name) LEFT JOIN entries r ON r.entry_pos = p.ref_pos
        WHERE e.source = 'project') t
  LEFT JOIN entries r ON r.entry_pos = t.ref_pos"""


def _fill(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    return fill_missing_specs(e.where(F.col("source") == "project"), e.where(F.col("source") == "reflib"))


@register("preferred_reference_row", O.prelude("entries", extra={"pref": _PREF}) + f"""
SELECT p.name, p.ref_pos, {J.format('e.requires_clauses')} AS requires, {J.format('e.ensures_clauses')} AS ensures
FROM pref p JOIN entries e ON e.entry_pos = p.ref_pos""")
def q_preferred_reference_row(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    p = preferred_reference_rows(e.where(F.col("source") == "reflib"))
    return p.select("name", "ref_pos", _joined("ref_requires").alias("requires"), _joined("ref_ensures").alias("ensures"))


@register("fill_missing_specs", O.prelude("entries", extra={"pref": _PREF, "fl": _FILL}) + f"""
SELECT entry_pos, {J.format('requires_clauses')} AS requires, {J.format('ensures_clauses')} AS ensures,
  documentation, filled FROM fl""")
def q_fill_missing_specs(spark: SparkSession, sf: str) -> DataFrame:
    return _fill(spark, sf).select("entry_pos", _joined("requires_clauses").alias("requires"),
                                   _joined("ensures_clauses").alias("ensures"), "documentation", "filled")


@register("fill_impact", O.prelude("entries", extra={"pref": _PREF, "fl": _FILL}) + """
SELECT CAST(count(*) FILTER (WHERE filled OR (len(requires_clauses) = 0 AND len(ensures_clauses) = 0)) AS BIGINT) AS missing_before,
  CAST(count(*) FILTER (WHERE len(requires_clauses) = 0 AND len(ensures_clauses) = 0) AS BIGINT) AS missing_after,
  CAST(count(*) FILTER (WHERE filled) AS BIGINT) AS filled FROM fl""")
def q_fill_impact(spark: SparkSession, sf: str) -> DataFrame:
    return fill_impact(_fill(spark, sf))


_EMBED_TEXT = """concat_ws(' ', name, nullif(documentation, ''), nullif(signature, ''),
  CASE WHEN len(requires_clauses) > 0 THEN array_to_string(requires_clauses, ' ') END,
  CASE WHEN len(ensures_clauses) > 0 THEN array_to_string(ensures_clauses, ' ') END)"""


@register("fill_specs_job", O.prelude("entries", extra={"pref": _PREF, "fl": _FILL}) + f"""
SELECT entry_pos, filled, {O.ids_digest(_EMBED_TEXT)} FROM fl""")
def q_fill_specs_job(spark: SparkSession, sf: str) -> DataFrame:
    """Q9: the fill with the vectors of its re-encoding."""
    e = fx.entries(spark, sf)
    done = fill_specs_job(e.where(F.col("source") == "project"), e.where(F.col("source") == "reflib"))
    out = done.entries.select("entry_pos", "filled")
    if done.vectors is None:  # nothing was filled: the old vectors stay
        return out.select("*", F.lit(0).alias("n_ids"), F.lit(0).cast("long").alias("ids_sum")).limit(0)
    return out.join(done.vectors, "entry_pos").select("entry_pos", "filled", *ids_digest("ids"))


# ---- A7 / A8 ------------------------------------------------------------------------------------------
@register("spec_coverage", O.prelude("entries") + """
SELECT coalesce(source, 'TOTAL') AS index_name, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE len(requires_clauses) > 0 OR len(ensures_clauses) > 0) AS BIGINT) AS with_specs,
  count(*) FILTER (WHERE len(requires_clauses) > 0 OR len(ensures_clauses) > 0) * CAST(100.0 AS DOUBLE) / count(*) AS pct
FROM entries GROUP BY ROLLUP (source)""")
def q_spec_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return spec_coverage(fx.entries(spark, sf))


PROJECTS = ("project", "reflib", "vstd")


@register("corpus_catalog", O.prelude("entries", "vectors") + """
SELECT p.name AS project, CAST(coalesce(g.entry_count, 0) AS BIGINT) AS entry_count, coalesce(g.has_vectors, false) AS has_vectors
FROM (VALUES """ + ", ".join(f"('{p}')" for p in PROJECTS) + """) p(name) LEFT JOIN (
  SELECT e.source, count(*) AS entry_count, bool_or(v.entry_pos IS NOT NULL) AS has_vectors
  FROM entries e LEFT JOIN vectors v USING (entry_pos) GROUP BY e.source) g ON g.source = p.name""")
def q_corpus_catalog(spark: SparkSession, sf: str) -> DataFrame:
    projects = spark.createDataFrame([(p,) for p in PROJECTS], "name string")
    return corpus_catalog(projects, fx.entries(spark, sf), fx.vectors(spark, sf))


# ---- J9 / J10 / J8 / J11 / U3 / Q10 ---------------------------------------------------------------------
_CK = {
    "ck": """SELECT entry_pos, list_sort(list_distinct(list_transform(requires_clauses, lambda x: trim(x)))) AS rk,
      list_sort(list_distinct(list_transform(ensures_clauses, lambda x: trim(x)))) AS ek FROM entries""",
    "ckf": "SELECT * FROM ck WHERE len(rk) > 0 OR len(ek) > 0",
    "exa": """SELECT 'exact' AS type, r.pos1, c.entry_pos AS pos2 FROM ckf c
      JOIN (SELECT rk, ek, min(entry_pos) AS pos1 FROM ckf GROUP BY rk, ek) r USING (rk, ek) WHERE c.entry_pos <> r.pos1""",
    "cls": "SELECT rk, ek, min(entry_pos) AS rep FROM ckf WHERE len(ek) > 0 GROUP BY rk, ek",
    "sub": """SELECT 'subsumes' AS type, c1.rep AS pos1, c2.rep AS pos2 FROM cls c1 JOIN cls c2
      ON c1.ek = c2.ek AND len(c1.rk) < len(c2.rk) AND list_has_all(c2.rk, c1.rk)""",
}


def _vec_entries() -> dict[str, str]:
    d = {"c": "SELECT * FROM entries"}
    d.update(O.corpus_vector_ctes("c"))
    return d


def _pair_sim(pairs: str) -> str:
    return f"""SELECT p.*, CAST(coalesce(d.dot, 0) AS DOUBLE) / sqrt(CAST(n1.n2 AS DOUBLE) * CAST(n2.n2 AS DOUBLE)) AS similarity
      FROM {pairs} p LEFT JOIN cen n1 ON n1.entry_pos = p.pos1 LEFT JOIN cen n2 ON n2.entry_pos = p.pos2
      LEFT JOIN (SELECT q.pos1, q.pos2, sum(a.v * b.v) AS dot FROM {pairs} q JOIN ces a ON a.entry_pos = q.pos1
                 JOIN ces b ON b.entry_pos = q.pos2 AND b.bucket = a.bucket GROUP BY ALL) d
        ON d.pos1 = p.pos1 AND d.pos2 = p.pos2"""


_NB = {
    "adot": """SELECT a.entry_pos AS pos1, b.entry_pos AS pos2, sum(a.v * b.v) AS dot FROM ces a JOIN ces b USING (bucket)
      WHERE a.entry_pos <> b.entry_pos GROUP BY ALL""",
    "apsc": """SELECT e1.entry_pos AS pos1, e2.entry_pos AS pos2,
      CAST(coalesce(d.dot, 0) AS DOUBLE) / sqrt(CAST(e1.n2 AS DOUBLE) * CAST(e2.n2 AS DOUBLE)) AS score
      FROM cen e1 JOIN cen e2 ON e1.entry_pos <> e2.entry_pos
      LEFT JOIN adot d ON d.pos1 = e1.entry_pos AND d.pos2 = e2.entry_pos""",
    "nb": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos1 ORDER BY score DESC, pos2) AS rank FROM apsc) x
      WHERE rank <= 10""",
    "sim": """SELECT 'similar' AS type, pos1, pos2, similarity FROM (
      SELECT least(pos1, pos2) AS pos1, greatest(pos1, pos2) AS pos2, max(score) AS similarity FROM nb
      WHERE score >= 0.9 GROUP BY ALL) s
      WHERE NOT EXISTS (SELECT 1 FROM ckf a JOIN ckf b ON a.ek = b.ek WHERE a.entry_pos = s.pos1 AND b.entry_pos = s.pos2
        AND (a.rk = b.rk OR (len(a.ek) > 0 AND (list_has_all(a.rk, b.rk) OR list_has_all(b.rk, a.rk)))))""",
}


def _audit_prelude(extra: dict[str, str] | None = None) -> str:
    d = dict(_CK)
    d.update(_vec_entries())
    d.update(_NB)
    # every pair of members, and those that reach the threshold
    d["mem"] = """SELECT c.entry_pos, r.rep FROM ckf c
      JOIN (SELECT rk, ek, min(entry_pos) AS rep FROM ckf GROUP BY rk, ek) r USING (rk, ek)"""
    d["mpairs"] = """SELECT 'exact' AS type, a.rep AS c1, b.rep AS c2, a.entry_pos AS pos1, b.entry_pos AS pos2
      FROM mem a JOIN mem b ON a.rep = b.rep AND a.entry_pos < b.entry_pos
      UNION ALL SELECT s.type, s.pos1, s.pos2, a.entry_pos, b.entry_pos
      FROM sub s JOIN mem a ON a.rep = s.pos1 JOIN mem b ON b.rep = s.pos2"""
    d["msim"] = _pair_sim("mpairs")
    d["linked"] = "SELECT * FROM msim WHERE similarity >= 0.75"
    d["allp"] = """SELECT type, c1 AS pos1, c2 AS pos2, max(similarity) AS similarity, CAST(count(*) AS BIGINT) AS n_links
      FROM linked GROUP BY ALL UNION ALL SELECT *, CAST(1 AS BIGINT) FROM sim"""
    d["named"] = """SELECT p.type, p.pos1, p.pos2, e1.name AS lemma1, e2.name AS lemma2, p.similarity, p.n_links,
      e1.file_path AS file1, e2.file_path AS file2 FROM allp p JOIN entries e1 ON e1.entry_pos = p.pos1
      JOIN entries e2 ON e2.entry_pos = p.pos2"""
    d.update(extra or {})
    return O.prelude("entries", extra=d)


@register("exact_duplicates", O.prelude("entries", extra=_CK) + "SELECT type, pos1, pos2 FROM exa")
def q_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(fx.entries(spark, sf))


@register("subsumed_pairs", O.prelude("entries", extra=_CK) + "SELECT type, pos1, pos2 FROM sub")
def q_subsumed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return subsumed_pairs(fx.entries(spark, sf))


@register("self_neighbours", O.prelude("vectors") + """
SELECT pos1, CAST(rank AS INTEGER) AS rank, pos2, round_even(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY pos1 ORDER BY score DESC, pos2) AS rank FROM (
    SELECT a.entry_pos AS pos1, b.entry_pos AS pos2,
      list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) /
      sqrt(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(a.v AS DOUBLE[])) * list_dot_product(CAST(b.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))) AS score
    FROM vectors a JOIN vectors b ON a.entry_pos <> b.entry_pos) x) y WHERE rank <= 10""")
def q_self_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    nb = nearest(fx.vectors(spark, sf), 10, "v")
    return nb.select("pos1", "rank", "pos2", F.bround("score", 6).alias("score"))


def _corpus(spark: SparkSession, sf: str):
    return build_corpus_index(fx.entries(spark, sf))


@register("similar_pairs", _audit_prelude() + "SELECT type, pos1, pos2, similarity FROM sim")
def q_similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    nb = nearest(c.vectors, 10, "ids", kind="ids", dims=c.cfg.dims, at_least=0.90)
    return similar_pairs(nb, c.entries, 0.90)


@register("combine_pairs", _audit_prelude() + "SELECT type, pos1, pos2, similarity, n_links FROM allp")
def q_combine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return detect_duplicates(_corpus(spark, sf), include_similar=True).select("type", "pos1", "pos2", "similarity", "n_links")


@register("detect_duplicates", _audit_prelude() + """
SELECT type, pos1, pos2, lemma1, lemma2, similarity, n_links, file1, file2 FROM named""")
def q_detect_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return detect_duplicates(_corpus(spark, sf), include_similar=True)


@register("duplicate_members", _audit_prelude() + """
SELECT m.entry_pos, m.rep AS class_id, CAST(coalesce(x.n, 0) AS BIGINT) AS n_exact, CAST(coalesce(a.n, 0) AS BIGINT) AS n_subsumes,
  CAST(coalesce(b.n, 0) AS BIGINT) AS n_subsumed
FROM mem m LEFT JOIN (SELECT p, count(*) AS n FROM (SELECT pos1 AS p FROM linked WHERE type = 'exact'
    UNION ALL SELECT pos2 FROM linked WHERE type = 'exact') u GROUP BY p) x ON x.p = m.entry_pos
  LEFT JOIN (SELECT pos1 AS p, count(*) AS n FROM linked WHERE type = 'subsumes' GROUP BY pos1) a ON a.p = m.entry_pos
  LEFT JOIN (SELECT pos2 AS p, count(*) AS n FROM linked WHERE type = 'subsumes' GROUP BY pos2) b ON b.p = m.entry_pos""")
def q_duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    """Q10 by entry: its class and the links it has itself."""
    return duplicate_members(_corpus(spark, sf))


# ---- F18 / A9 / A10 / W3 / Q11 --------------------------------------------------------------------------
def _cat_sql(a: str, b: str) -> str:
    from ..operators.duplicates import INCREMENTAL_MARKERS, SYMMETRIC_MARKERS

    inc = " OR ".join(f"contains({a}, '{m}')" for m in INCREMENTAL_MARKERS)
    sym = " OR ".join(f"contains({a} || {b}, '{m}')" for m in SYMMETRIC_MARKERS)
    ab = f"({a} || {b})"
    return f"""CASE WHEN contains(lower({a}), 'limb') AND contains(lower({b}), 'limb') THEN 'limb_variants'
      WHEN {inc} THEN 'incremental_lemmas' WHEN {sym} THEN 'symmetric_variants'
      WHEN (contains({ab}, '_le') AND contains({ab}, '_lt')) OR (contains({ab}, 'mul_le') AND contains({ab}, 'mul_lt'))
      THEN 'comparison_variants' ELSE 'other' END"""


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return detect_duplicates(_corpus(spark, sf), include_similar=True)


@register("categorize_pair", _audit_prelude() + f"""
SELECT pos1, pos2, {_cat_sql('lemma1', 'lemma2')} AS pattern FROM named WHERE type = 'similar'""")
def q_categorize_pair(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).where(F.col("type") == "similar").select("pos1", "pos2", categorize_pair().alias("pattern"))


@register("duplicate_type_counts", _audit_prelude() + """
SELECT t.type, CAST(coalesce(g.n, 0) AS BIGINT) AS n FROM (VALUES ('exact'), ('subsumes'), ('similar')) t(type)
LEFT JOIN (SELECT type, sum(n_links) AS n FROM named GROUP BY type) g USING (type)""")
def q_duplicate_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return type_counts(_named(spark, sf))


_PATTERN_ROWS = ", ".join(f"('{p}', {i})" for i, p in enumerate(PATTERNS))
_PATTERN_COUNTS = f"""SELECT p.pattern, p.pattern_no, CAST(coalesce(g.n, 0) AS BIGINT) AS n
FROM (VALUES {_PATTERN_ROWS}) p(pattern, pattern_no)
LEFT JOIN (SELECT {_cat_sql('lemma1', 'lemma2')} AS pattern, count(*) AS n FROM named WHERE type = 'similar' GROUP BY 1) g
USING (pattern)"""


@register("pattern_counts", _audit_prelude() + _PATTERN_COUNTS)
def q_pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pattern_counts(_named(spark, sf))


@register("duplicate_report", _audit_prelude({"pc": _PATTERN_COUNTS}) + f"""
SELECT 'types' AS section, t.type AS key, CAST(coalesce(g.n, 0) AS BIGINT) AS n, CAST(NULL AS INTEGER) AS example_no,
  CAST(NULL AS BIGINT) AS pos1, CAST(NULL AS BIGINT) AS pos2, CAST(NULL AS BIGINT) AS more
FROM (VALUES ('exact'), ('subsumes'), ('similar')) t(type)
LEFT JOIN (SELECT type, sum(n_links) AS n FROM named GROUP BY type) g USING (type)
UNION ALL SELECT 'patterns', pattern, n, NULL, NULL, NULL, NULL FROM pc
UNION ALL SELECT 'examples', pattern, NULL, CAST(example_no AS INTEGER), pos1, pos2, CAST(more AS BIGINT) FROM (
  SELECT {_cat_sql('lemma1', 'lemma2')} AS pattern, pos1, pos2,
    row_number() OVER (PARTITION BY {_cat_sql('lemma1', 'lemma2')} ORDER BY pos1, pos2) AS example_no,
    greatest(count(*) OVER (PARTITION BY {_cat_sql('lemma1', 'lemma2')}) - 3, 0) AS more
  FROM named WHERE type = 'similar') x WHERE example_no <= 3""")
def q_duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Q11: type counts, pattern counts and examples of one detection."""
    return duplicate_report(_named(spark, sf))


# ---- W4 / A13 ------------------------------------------------------------------------------------------
def _expected(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.passage_matches(spark, sf)
    d = fx.table(spark, sf, "documents").select("doc_id", "source")
    return m.join(d, "doc_id").select(
        F.col("source").alias("case"), F.col("item_id").alias("query_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.lit(0).alias("position"))


def _eval_sql(select: str) -> str:
    ctes = {"c": "SELECT * FROM docs"}
    ctes.update(O.corpus_vector_ctes("c"))
    ctes.update(O.fuzzy_ctes("f_", "c", "query_batch", "query_id", "query", 10))
    ctes["ex"] = """SELECT DISTINCT d.source AS "case", b.item_id AS query_id, 'doc_' || CAST(d.doc_id AS VARCHAR) AS name, 0 AS position
      FROM benchmark b JOIN documents d ON length(b.text) > 0 AND instr(d.text, b.text) > 0"""
    ctes["pq"] = """SELECT ex."case", ex.query_id, ex.name, ex.position, CAST(f.rank - 1 AS INTEGER) AS position_found,
      coalesce(f.rank - 1 <= ex.position + 2, false) AS passed
      FROM ex LEFT JOIN f_fz f ON f.query_id = ex.query_id AND f.name = ex.name"""
    return O.prelude("docs", "query_batch", extra=ctes) + select


@register("expected_rank", _eval_sql('SELECT "case", query_id, name, position, position_found, passed FROM pq'))
def q_expected_rank(spark: SparkSession, sf: str) -> DataFrame:
    hits = fuzzy_search(build_corpus_index(fx.docs(spark, sf)), fx.query_batch(spark, sf), 10)
    per_query, _ = retrieval_eval(hits, _expected(spark, sf))
    return per_query.select("case", "query_id", "name", "position", F.col("position_found").cast("int"), "passed")


@register("retrieval_eval", _eval_sql("""SELECT "case", CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS passed,
  CAST(count(*) AS BIGINT) AS total, count(*) FILTER (WHERE passed) * CAST(100.0 AS DOUBLE) / count(*) AS pct FROM pq GROUP BY 1"""))
def q_retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    hits = fuzzy_search(build_corpus_index(fx.docs(spark, sf)), fx.query_batch(spark, sf), 10)
    _, summary = retrieval_eval(hits, _expected(spark, sf))
    return summary


@register("examples_per_category", _audit_prelude() + """
SELECT type, pos1, pos2, CAST(example_no AS INTEGER) AS example_no, CAST(more AS BIGINT) AS more FROM (
  SELECT type, pos1, pos2, row_number() OVER (PARTITION BY type ORDER BY pos1, pos2) AS example_no,
    greatest(count(*) OVER (PARTITION BY type) - 5, 0) AS more FROM named) x WHERE example_no <= 5""")
def q_examples_per_category(spark: SparkSession, sf: str) -> DataFrame:
    """First 5 pairs per type (markdown form) and how many more."""
    ex = examples_per_group(write_stage(_named(spark, sf), "pairs"), "type", [F.col("pos1"), F.col("pos2")], 5)
    return ex.select("type", "pos1", "pos2", "example_no", "more")
