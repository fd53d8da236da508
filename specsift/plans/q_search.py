"""Registered search queries (Q2-Q6, F5, P5, J4, J12, J13, A12) with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_query, query_variations
from ..operators.blend import best_over_variations, hybrid_combine, max_normalize
from ..operators.keyword import keyword_index, keyword_scores
from ..operators.topk import first_per_key, top_k
from ..sources import fixtures as fx
from . import oracle as O
from ._reg import register
from .graph import enrich_graph, enrichment_stats
from .q_text import normalize_sql, variations_sql
from .search import (build_corpus_index, fuzzy_search, hybrid_search, keyword_search, lookup_by_name, result_projection,
                     routed_search, semantic_search, similar_entries)

HITS = ["query_id", "rank", "entry_pos", "name", "score"]


def _vec(corpus: str) -> dict[str, str]:
    d = {"c": f"SELECT * FROM {corpus}"}
    d.update(O.corpus_vector_ctes("c"))
    return d


# ---- Q2 -------------------------------------------------------------------------
def _semantic_sql(corpus: str, k: int) -> str:
    ctes = _vec(corpus)
    ctes.update(O.semantic_ctes("s_", "c", "query_batch", ["query_id"], "query", k))
    return O.prelude(corpus, "query_batch", extra=ctes) + "SELECT query_id, rank, entry_pos, name, score FROM s_sem"


@register("semantic_search", _semantic_sql("entries", 10))
def q_semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    c = build_corpus_index(fx.entries(spark, sf))
    return semantic_search(c, fx.query_batch(spark, sf), 10).select(*HITS)


@register("semantic_search_docs", _semantic_sql("docs", 10))
def q_semantic_search_docs(spark: SparkSession, sf: str) -> DataFrame:
    c = build_corpus_index(fx.docs(spark, sf))
    return semantic_search(c, fx.query_batch(spark, sf), 10).select(*HITS)


# ---- Q3 -------------------------------------------------------------------------
def _hybrid_sql(corpus: str, k: int) -> str:
    ctes = _vec(corpus)
    ctes.update(O.semantic_ctes("h_", "c", "query_batch", ["query_id"], "query", 2 * k))
    ctes.update(O.keyword_top_ctes("h_", "c", "query_batch", ["query_id"], "query", 2 * k))
    ctes.update(O.hybrid_ctes("h_", ["query_id"], k))
    return O.prelude(corpus, "query_batch", extra=ctes) + "SELECT query_id, rank, entry_pos, name, score FROM h_hyb"


@register("hybrid_search", _hybrid_sql("entries", 10))
def q_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    c = build_corpus_index(fx.entries(spark, sf))
    return hybrid_search(c, fx.query_batch(spark, sf), 10).select(*HITS)


# ---- Q4 -------------------------------------------------------------------------
def _fuzzy_sql(corpus: str, k: int, select: str = "SELECT query_id, rank, entry_pos, name, score FROM f_fz") -> str:
    ctes = _vec(corpus)
    ctes.update(O.fuzzy_ctes("f_", "c", "query_batch", "query_id", "query", k))
    return O.prelude(corpus, "query_batch", extra=ctes) + select


@register("fuzzy_search", _fuzzy_sql("entries", 10))
def q_fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    c = build_corpus_index(fx.entries(spark, sf))
    return fuzzy_search(c, fx.query_batch(spark, sf), 10).select(*HITS)


@register("fuzzy_search_docs", _fuzzy_sql("docs", 10))
def q_fuzzy_search_docs(spark: SparkSession, sf: str) -> DataFrame:
    c = build_corpus_index(fx.docs(spark, sf))
    return fuzzy_search(c, fx.query_batch(spark, sf), 10).select(*HITS)


@register("fuzzy_search_keyword_only", O.prelude("entries", "query_batch", extra={
    "c": "SELECT * FROM entries",
    "nq": f"SELECT query_id, {normalize_sql('query')} AS nq FROM query_batch",
    **O.keyword_top_ctes("k_", "c", "nq", ["query_id"], "nq", 10)}) + "SELECT query_id, rank, entry_pos, name, score FROM k_kwt")
def q_fuzzy_search_keyword_only(spark: SparkSession, sf: str) -> DataFrame:
    c = build_corpus_index(fx.entries(spark, sf), with_vectors=False)
    return fuzzy_search(c, fx.query_batch(spark, sf), 10).select(*HITS)


# ---- F5 / P5 ----------------------------------------------------------------------
_PROJ = """SELECT f.query_id, f.rank, f.name, round_even(f.score, 3) AS score, c.file_path, c.line_number, c.signature, c.source
FROM f_fz f JOIN c USING (entry_pos)"""


@register("result_projection", _fuzzy_sql("entries", 10, _PROJ))
def q_result_projection(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    hits = fuzzy_search(build_corpus_index(e), fx.query_batch(spark, sf), 10)
    return result_projection(hits, e).select("query_id", "rank", "name", "score", "file_path", "line_number",
                                              "signature", "source")


@register("filter_by_source", _fuzzy_sql("entries", 10, "SELECT * FROM (" + _PROJ + ") p WHERE source = 'reflib'"))
def q_filter_by_source(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    hits = fuzzy_search(build_corpus_index(e), fx.query_batch(spark, sf), 10)
    out = result_projection(hits, e).where(F.col("source") == "reflib")
    return out.select("query_id", "rank", "name", "score", "file_path", "line_number", "signature", "source")


# ---- J4 ----------------------------------------------------------------------------
@register("lookup_by_name", O.prelude("entries", "nodes") + """
SELECT n.display_name AS name, min(d.entry_pos) AS entry_pos FROM (SELECT DISTINCT display_name FROM nodes) n
JOIN (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS name, doc_id AS entry_pos FROM documents
      UNION ALL SELECT name, entry_pos FROM entries) d ON d.name = n.display_name GROUP BY n.display_name""")
def q_lookup_by_name(spark: SparkSession, sf: str) -> DataFrame:
    corpus = fx.docs(spark, sf).select("entry_pos", "name").unionByName(fx.entries(spark, sf).select("entry_pos", "name"))
    names = fx.nodes(spark, sf).select(F.col("display_name").alias("q")).distinct()
    return lookup_by_name(corpus, names, "q").select("name", "entry_pos")


# ---- Q5 ----------------------------------------------------------------------------
def _similar_sql(k: int) -> str:
    ctes = _vec("entries")
    ctes["q5"] = f"""SELECT e.entry_pos AS query_id, e.name AS src_name, {O._ops(O.searchable('e'))} AS query
        FROM (SELECT min(entry_pos) AS entry_pos FROM entries GROUP BY name) f JOIN entries e USING (entry_pos)"""
    ctes.update(O.fuzzy_ctes("f_", "c", "q5", "query_id", "query", k + 1))
    return O.prelude("entries", extra=ctes) + f"""
SELECT query_id, rank2 AS rank, entry_pos, name, score FROM (
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank2,
  entry_pos, name, score FROM (SELECT f.* FROM f_fz f JOIN q5 USING (query_id) WHERE f.name <> q5.src_name) x) y
WHERE rank2 <= {k}"""


@register("similar_entries", _similar_sql(5))
def q_similar_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entries(spark, sf)
    names = e.groupBy("name").agg(F.min("entry_pos").alias("query_id"))
    return similar_entries(build_corpus_index(e), names, 5).select(*HITS)


# ---- Q6 ----------------------------------------------------------------------------
def _routed_sql(k: int) -> str:
    ctes = _vec("docs")
    ctes["rq"] = """SELECT query_id, query FROM query_batch UNION ALL
        SELECT -1 - min(node_id) AS query_id, display_name AS query FROM nodes GROUP BY display_name"""
    ctes["named"] = "SELECT rq.query_id, d.entry_pos, d.name AS src_name FROM rq JOIN (SELECT min(entry_pos) AS entry_pos, name FROM docs GROUP BY name) d ON d.name = rq.query"
    ctes["free"] = "SELECT * FROM rq WHERE query NOT IN (SELECT name FROM docs)"
    ctes["q5"] = f"""SELECT n.query_id, n.src_name, {O._ops(O.searchable('e'))} AS query FROM named n JOIN docs e USING (entry_pos)"""
    ctes.update(O.fuzzy_ctes("a_", "c", "q5", "query_id", "query", k + 1))
    ctes.update(O.fuzzy_ctes("b_", "c", "free", "query_id", "query", k + 1))
    return O.prelude("docs", "query_batch", "nodes", extra=ctes) + f"""
SELECT query_id, rank2 AS rank, entry_pos, name, score FROM (
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank2, entry_pos, name, score
FROM (SELECT f.* FROM a_fz f JOIN q5 USING (query_id) WHERE f.name <> q5.src_name
      UNION ALL
      SELECT f.* FROM b_fz f JOIN free USING (query_id)
      WHERE f.name <> coalesce(regexp_extract(free.query, '^\\s*(\\S+)', 1), '')) x) y
WHERE rank2 <= {k}"""


@register("routed_search", _routed_sql(3))
def q_routed_search(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.nodes(spark, sf).groupBy("display_name").agg((-1 - F.min("node_id")).alias("query_id"))
    q = fx.query_batch(spark, sf).unionByName(n.select("query_id", F.col("display_name").alias("query")))
    return routed_search(build_corpus_index(fx.docs(spark, sf)), q, 3).select(*HITS)


# ---- J12 / J13 / A12 ---------------------------------------------------------------
def _graph_ctes(k: int) -> dict[str, str]:
    ctes = _vec("docs")
    ctes["nq"] = """SELECT node_id, display_name, CASE WHEN coalesce(body, '') <> '' THEN display_name || ' ' ||
        array_to_string(string_split(body, chr(10))[1:5], ' ') ELSE display_name END AS query
        FROM nodes WHERE coalesce(display_name, '') <> ''"""
    ctes.update(O.fuzzy_ctes("g_", "c", "nq", "node_id", "query", k + 1))
    ctes["ex"] = f"""SELECT node_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY rank) AS INTEGER) AS rank,
        entry_pos, name, score FROM (SELECT f.* FROM g_fz f JOIN nq USING (node_id) WHERE f.name <> nq.display_name) x
        QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY x.rank) <= {k}"""
    return ctes


@register("exclude_self", O.prelude("docs", "nodes", extra=_graph_ctes(3)) +
          "SELECT node_id, rank, entry_pos, name, score FROM ex")
def q_exclude_self(spark: SparkSession, sf: str) -> DataFrame:
    g = enrich_graph(build_corpus_index(fx.docs(spark, sf)), fx.nodes(spark, sf), 3, flat=True)
    return g.select("node_id", "rank", "entry_pos", "name", "score")


@register("enrich_graph", O.prelude("docs", "nodes", extra=_graph_ctes(3)) + """
SELECT n.node_id, n.display_name, CAST(coalesce(len(s.names), 0) AS INTEGER) AS n_similar,
  array_to_string(s.names, ',') AS similar_names, s.top_score
FROM nodes n LEFT JOIN (SELECT node_id, list(name ORDER BY rank) AS names, max(round_even(score, 3)) AS top_score
                        FROM ex GROUP BY node_id) s USING (node_id)""")
def q_enrich_graph(spark: SparkSession, sf: str) -> DataFrame:
    g = enrich_graph(build_corpus_index(fx.docs(spark, sf)), fx.nodes(spark, sf), 3)
    return g.select(
        "node_id", "display_name",
        F.coalesce(F.size("similar_lemmas"), F.lit(0)).cast("int").alias("n_similar"),
        F.array_join(F.transform("similar_lemmas", lambda s: s["name"]), ",").alias("similar_names"),
        F.array_max(F.transform("similar_lemmas", lambda s: s["score"])).alias("top_score"),
    )


@register("enrichment_stats", O.prelude("docs", "nodes", extra=_graph_ctes(3)) + """
SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS nodes_processed,
       CAST((SELECT count(DISTINCT node_id) FROM ex) AS BIGINT) AS nodes_enriched""")
def q_enrichment_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = enrich_graph(build_corpus_index(fx.docs(spark, sf)), fx.nodes(spark, sf), 3)
    return enrichment_stats(g)


# ---- component keys of SURVEY 2.4-2.7 (J5/A1, J6, J7/A2, A3, W1, W2, U4) ----------------------------------


def _kw_all_sql(corpus: str) -> str:
    ctes = {"c": f"SELECT * FROM {corpus}", "qb": "SELECT * FROM query_batch"}
    ctes.update(O.keyword_scores_sql("c", "qb"))
    return O.prelude(corpus, "query_batch", extra=ctes)


@register("keyword_score", _kw_all_sql("entries") + "SELECT query_id, entry_pos, score FROM kw")
def q_keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    """A1: every (query, entry) keyword score > 0 (no cut)."""
    return keyword_scores(keyword_index(fx.entries(spark, sf)), fx.query_batch(spark, sf)).select(
        "query_id", "entry_pos", "score")


@register("keyword_match", _kw_all_sql("docs") + "SELECT query_id, entry_pos, score FROM kw")
def q_keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted-index join over the large text corpus (all pairs)."""
    return keyword_scores(keyword_index(fx.docs(spark, sf)), fx.query_batch(spark, sf)).select(
        "query_id", "entry_pos", "score")


@register("cosine_match", _semantic_sql("docs", 40))
def q_cosine_match(spark: SparkSession, sf: str) -> DataFrame:
    """Query vectors against every corpus vector, deeper cut (40)."""
    c = build_corpus_index(fx.docs(spark, sf))
    return semantic_search(c, fx.query_batch(spark, sf), 40).select(*HITS)


@register("topk_per_query", _kw_all_sql("entries") + """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_pos) AS INTEGER) AS rank,
  entry_pos, score FROM kw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_pos) <= 5""")
def q_topk_per_query(spark: SparkSession, sf: str) -> DataFrame:
    """W1 on the all-pairs keyword scores (window form)."""
    s = keyword_scores(keyword_index(fx.entries(spark, sf)), fx.query_batch(spark, sf))
    return top_k(s, ["query_id"], 5, [F.col("score").desc(), F.col("entry_pos").asc()]).select(
        "query_id", "rank", "entry_pos", "score")


def _mn_sql(n: int) -> str:
    ctes = _vec("entries")
    ctes.update(O.semantic_ctes("s_", "c", "query_batch", ["query_id"], "query", n))
    return O.prelude("entries", "query_batch", extra=ctes)


@register("max_normalize", _mn_sql(20) + """
SELECT s.query_id, s.entry_pos, CASE WHEN m.mx > 0 THEN s.score / m.mx ELSE 0.0 END AS norm
FROM s_sem s JOIN (SELECT query_id, max(score) AS mx FROM s_sem GROUP BY query_id) m USING (query_id)""")
def q_max_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """A2 on the semantic top-20 lists."""
    c = build_corpus_index(fx.entries(spark, sf))
    return max_normalize(semantic_search(c, fx.query_batch(spark, sf), 20), ["query_id"]).select(
        "query_id", "entry_pos", "norm")


@register("hybrid_combine", _hybrid_sql("docs", 10))
def q_hybrid_combine(spark: SparkSession, sf: str) -> DataFrame:
    """The name-keyed blend on the text corpus."""
    c = build_corpus_index(fx.docs(spark, sf))
    q = fx.query_batch(spark, sf)
    sem = semantic_search(c, q, 20)
    kw = keyword_search(c.keyword, q, 20)
    return hybrid_combine(sem, kw, ["query_id"], 10, c.cfg.keyword_weight).select(*HITS)


@register("best_over_variations", _fuzzy_sql("entries", 5))
def q_best_over_variations(spark: SparkSession, sf: str) -> DataFrame:
    """A3: per name best over the variations of each query (fuzzy, k=5)."""
    c = build_corpus_index(fx.entries(spark, sf))
    q = fx.query_batch(spark, sf).select("query_id", normalize_query("query").alias("nq"))
    var = q.select("query_id", F.posexplode(query_variations("nq")).alias("var_pos", "variation"))
    hits = hybrid_search(c, var, 10, ["query_id", "var_pos"], "variation")
    return best_over_variations(hits, "query_id", "var_pos", 5).select(*HITS)


@register("first_match_per_name", O.prelude("entries") + """
SELECT name, min(entry_pos) AS entry_pos FROM entries GROUP BY name""")
def q_first_match_per_name(spark: SparkSession, sf: str) -> DataFrame:
    """First entry in corpus order for every name."""
    return first_per_key(fx.entries(spark, sf), "name").select("name", "entry_pos")


@register("distinct_variations", O.prelude("query_batch") + f"""
SELECT query_id, CAST(count(*) AS BIGINT) AS n_variations, max(var_pos) AS last_pos FROM (
{variations_sql('query_batch', 'query_id', normalize_sql('query'))}) v GROUP BY query_id""")
def q_distinct_variations(spark: SparkSession, sf: str) -> DataFrame:
    """U4: distinct variations per query, first position kept."""
    v = fx.query_batch(spark, sf).select(
        "query_id", F.posexplode(query_variations(normalize_query("query"))).alias("var_pos", "variation"))
    return v.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_variations"), F.max("var_pos").alias("last_pos"))
