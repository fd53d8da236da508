"""Search plans over a batch of queries: keyword (Q1), semantic (Q2),
hybrid (Q3), fuzzy (Q4), similar-to-entry (Q5) and routed search (Q6).

A ``Corpus`` bundles the per-entry columns each scorer needs; it is built
once and reused by every batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.encode import token_ids
from ..functions.text import normalize_query, query_variations, searchable_text, terms, tokens
from ..operators.blend import best_over_variations, hybrid_combine
from ..operators.common import materialize, spread
from ..operators.keyword import KeywordIndex, index_keywords, keyword_topn
from ..operators.queries import QueryBatch, prepare_queries
from ..operators.topk import first_per_key, top_k
from ..operators.vectors import cosine_topn
from ..session import write_stage

ENTRY_ARGS = ("name", "documentation", "signature", "requires_clauses", "ensures_clauses")


@dataclass
class Corpus:
    entries: DataFrame
    words: DataFrame  # entry_pos, name, terms, name_runs, doc_runs
    vectors: DataFrame | None  # entry_pos, name, ids  (None: keyword-only corpus)
    cfg: SearchConfig

    @cached_property
    def keyword(self) -> KeywordIndex:
        """The postings index, written when a search first needs it."""
        return index_keywords(self.words)

    @property
    def has_vectors(self) -> bool:
        return self.vectors is not None


def build_corpus_index(entries: DataFrame, with_vectors: bool = True, cfg: SearchConfig = SearchConfig(),
                       persist: bool = True) -> Corpus:
    """One pass over the corpus computes every per-entry column the scorers
    need (keyword terms and word runs, hashed ids); with ``persist`` these
    are written once so each scorer reads them instead of re-deriving them
    from the source tables.  The entries' own columns are not written again:
    joins read those that they need from the source."""
    own = ["entry_pos", "name", "terms", "name_runs", "doc_runs"] + ["ids"] * with_vectors
    idx = _index_columns(spread(entries, "entry_pos"), with_vectors, cfg).select(own)
    if persist:
        idx = materialize(idx)
    words = idx.select("entry_pos", "name", "terms", "name_runs", "doc_runs")
    vec = idx.select("entry_pos", "name", "ids") if with_vectors else None
    return Corpus(entries, words, vec, cfg)


def _index_columns(entries: DataFrame, with_vectors: bool, cfg: SearchConfig) -> DataFrame:
    """Tokenise the searchable text once; terms are its distinct tokens and
    the hashed ids come from the same tokens after operator rewriting."""
    doc = F.coalesce("documentation", F.lit(""))
    t = entries.select("*", tokens(searchable_text("name", doc, "signature", "requires_clauses",
                                                   "ensures_clauses")).alias("_tok"))
    extra = [
        F.array_distinct("_tok").alias("terms"),
        terms("name").alias("name_runs"),
        terms(doc).alias("doc_runs"),
    ]
    if with_vectors:
        extra.append(token_ids(F.col("_tok"), cfg.dims, rewrite=True).alias("ids"))
    return t.select(*entries.columns, *extra)


def keyword_search(index: KeywordIndex, queries: DataFrame, k: int = 10, keys: Sequence[str] = ("query_id",),
                   text_col: str = "query", cfg: SearchConfig = SearchConfig(), batch: QueryBatch | None = None) -> DataFrame:
    """Q1: keys..., rank, entry_pos, name, score (ties: corpus order)."""
    return keyword_topn(index, batch or prepare_queries(queries, keys, text_col, cfg.dims), k, cfg)


def semantic_search(corpus: Corpus, queries: DataFrame, k: int = 10, keys: Sequence[str] = ("query_id",),
                    text_col: str = "query", batch: QueryBatch | None = None) -> DataFrame:
    """Q2: cosine top-k; keyword search when the corpus has no vectors."""
    batch = batch or prepare_queries(queries, keys, text_col, corpus.cfg.dims)
    if not corpus.has_vectors:
        return keyword_topn(corpus.keyword, batch, k, corpus.cfg)
    return cosine_topn(corpus.vectors, batch, k, corpus.cfg.dims)


def hybrid_search(corpus: Corpus, queries: DataFrame, k: int = 10, keys: Sequence[str] = ("query_id",),
                  text_col: str = "query") -> DataFrame:
    """Q3: blend semantic and keyword top-2k lists by name, keep k.  Both lists
    are written, so that only one search has shuffle files at a time."""
    if not corpus.has_vectors:
        return keyword_search(corpus.keyword, queries, k, keys, text_col, corpus.cfg)
    batch = prepare_queries(queries, keys, text_col, corpus.cfg.dims)
    sem = write_stage(semantic_search(corpus, queries, 2 * k, keys, text_col, batch), "semantic")
    kw = write_stage(keyword_search(corpus.keyword, queries, 2 * k, keys, text_col, corpus.cfg, batch), "keyword")
    return hybrid_combine(sem, kw, keys, k, corpus.cfg.keyword_weight)


def fuzzy_search(corpus: Corpus, queries: DataFrame, k: int = 10, key: str = "query_id",
                 text_col: str = "query") -> DataFrame:
    """Q4: normalise, expand to variations, hybrid(2k) per variation, best per
    name, keep k.  Without vectors: keyword search on the normalised query."""
    nq = spread(queries, key).select(key, normalize_query(text_col).alias("nq"))
    if not corpus.has_vectors:
        return keyword_search(corpus.keyword, nq, k, [key], "nq", corpus.cfg)
    var = nq.select(key, F.posexplode(query_variations("nq")).alias("var_pos", "variation"))
    hits = hybrid_search(corpus, var, 2 * k, [key, "var_pos"], "variation")
    return best_over_variations(hits, key, "var_pos", k)


def first_named(entries: DataFrame, names: DataFrame, name_col: str) -> DataFrame:
    """The first entry (corpus order) of every asked name; no other entry is sorted."""
    # written, so that its size tells Spark whether to send it to the entries
    asked = write_stage(names.select(F.col(name_col).alias("_asked")).distinct(), "asked")
    return first_per_key(entries.join(asked, entries["name"] == asked["_asked"], "left_semi"), "name")


def lookup_by_name(entries: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """The first entry (corpus order) for each requested name."""
    first = first_named(entries, names, name_col)
    return names.join(first, names[name_col] == first["name"]).drop(names[name_col])


def exclude_and_cut(hits: DataFrame, key: str, k: int, exclude: F.Column) -> DataFrame:
    """Drop self hits, then keep the first k (re-ranked)."""
    kept = hits.where(~exclude).withColumnRenamed("rank", "_r")
    return top_k(kept, [key], k, [F.col("_r").asc()]).drop("_r")


def similar_entries(corpus: Corpus, names: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """Q5: for each (key, name): the entry's normalised text as a fuzzy query
    with k+1, drop same-name hits, keep k.  Unknown names give no rows."""
    src = lookup_by_name(corpus.entries, names.select(key, F.col("name").alias("_src_name")), "_src_name")
    q = src.select(key, F.col("name").alias("src_name"),
                   searchable_text(*ENTRY_ARGS, normalize=True).alias("query"))
    q = write_stage(q, "similar")  # the search and the exclusion read it
    hits = fuzzy_search(corpus, q.select(key, "query"), k + 1, key, "query")
    hits = hits.join(q.select(key, "src_name"), key)
    return exclude_and_cut(hits, key, k, F.col("name") == F.col("src_name")).drop("src_name")


def routed_search(corpus: Corpus, queries: DataFrame, k: int = 3, key: str = "query_id",
                  text_col: str = "query", exclude_self: bool = True, detect_names: bool = True) -> DataFrame:
    """Q6: a query that is an entry name searches with that entry's normalised
    text (Q5; not without ``detect_names``); any other query searches as typed,
    minus hits named like its first word.  Both kinds use depth k+1 when
    excluding, so they run as one fuzzy batch."""
    first = first_named(corpus.entries, queries, text_col)
    j = queries.join(first.select(F.col("name").alias("_n"), *[first[c] for c in ENTRY_ARGS if c != "name"]),
                     queries[text_col] == F.col("_n"), "left")
    named = F.col("_n").isNotNull() & F.lit(detect_names)
    text = F.when(named, searchable_text(F.col("_n"), *ENTRY_ARGS[1:], normalize=True)).otherwise(F.col(text_col))
    excl = F.when(named, F.col("_n")).otherwise(
        F.regexp_extract(text_col, r"^\s*(\S+)", 1) if exclude_self else F.lit(None).cast("string"))
    # written: the search and the exclusion read it
    q = write_stage(j.select(key, text.alias("_q"), excl.alias("_x"), named.alias("_named")), "routed")
    if exclude_self:
        hits = fuzzy_search(corpus, q.select(key, F.col("_q").alias("query")), k + 1, key, "query")
        hits = hits.join(q.select(key, "_x"), key)
        return exclude_and_cut(hits, key, k, F.col("name") == F.col("_x")).drop("_x")
    by_name = similar_entries(corpus, q.where("_named").select(key, F.col("_x").alias("name")), k, key)
    free = q.where(~F.col("_named")).select(key, F.col("_q").alias("query"))
    return by_name.unionByName(fuzzy_search(corpus, free, k, key, "query"))


def result_projection(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """keep name, score (half-even to 3 places), path, line, signature, source."""
    e = entries.select("entry_pos", "file_path", "line_number", "signature", "source")
    return hits.join(e, "entry_pos").select(
        *[c for c in hits.columns if c not in ("score", "entry_pos", "name")],
        "name", F.bround("score", 3).alias("score"), "file_path", "line_number", "signature", "source",
    )
