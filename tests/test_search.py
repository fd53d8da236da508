"""Search plans: against the DuckDB statements on a small inline corpus, with
hand-computed scores, and the same results for every cut of queries and corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import small_oracle
from specsift.operators import keyword, queries as Q, vectors
from specsift.operators.keyword import keyword_index, term_facts
from specsift.operators.qgrams import gram_index, substring_pairs
from specsift.operators.queries import prepare_queries, query_batch
from specsift.operators.vectors import Coded, bounds, cosine_topn
from specsift.plans.evaluate import retrieval_eval
from specsift.plans.search import (build_corpus_index, fuzzy_search, hybrid_search, keyword_search,
                                   routed_search, semantic_search, similar_entries)

CORPUS = [
    ("lemma_mul_le_implies_div_le", "If a * b <= c then a <= c / b", ["b > 0", "a * b <= c"], ["a <= c / b"]),
    ("lemma_mul_strictly_positive", "Product of positives is positive", ["x > 0", "y > 0"], ["x * y > 0"]),
    ("lemma_small_mod", "Small values are unchanged by mod", ["x < m"], ["x % m == x"]),
    ("lemma_div_strictly_bounded", "Division is strictly bounded", ["x < a * b", "b > 0"], ["x / b < a"]),
    ("lemma_multiply_divide_lt", "Multiply then divide keeps order", ["a < b * c"], ["a / c < b"]),
    ("lemma_mod_range", "Result of mod lies in range", ["m > 0"], ["0 <= x % m", "x % m < m"]),
    ("lemma_add_comm", "Addition commutes", [], ["a + b == b + a"]),
    ("lemma_mul_comm", "Multiplication commutes", [], ["a * b == b * a"]),
    ("lemma_mul_comm", "Duplicate name, other file", [], ["a * b == b * a"]),
    ("axiom_zero", "", [], []),
]
QUERIES = [
    "if a times b <= c then a <= c div b", "x <= z / y if x * y <= z and y > 0",
    "if m * n <= p then m <= p / n", "a <= c / b when a mul b <= c",
    "if a > 0 and b > 0 then a * b > 0", "a mul b > 0 if a > 0 and b > 0",
    "product is positive if both factors are positive", "if x < m then x mod m = x",
    "x modulo m equals x when x < m", "small value mod is identity",
    "x < a * b implies x / b < a", "division upper bound", "lemma_mul_comm",
]
GROUPS = [("div_from_mul", "lemma_mul_le_implies_div_le", range(0, 4)),
          ("mul_positive", "lemma_mul_strictly_positive", range(4, 7)),
          ("small_mod", "lemma_small_mod", range(7, 10))]


SCHEMA = ("entry_pos long, name string, file_path string, line_number int, documentation string, signature string, "
          "requires_clauses array<string>, ensures_clauses array<string>, symbol_id string, source string")


def _entries():
    return [dict(entry_pos=i, name=n, file_path=f"src/f{i % 3}.rs", line_number=i + 1, documentation=d,
                 signature=f"pub proof fn {n}(x: int)", requires_clauses=r, ensures_clauses=e, symbol_id=f"s{i}",
                 source="project") for i, (n, d, r, e) in enumerate(CORPUS)]


@pytest.fixture(scope="module")
def corpus(spark):
    return build_corpus_index(spark.createDataFrame(_entries(), SCHEMA))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.entry_pos, r.name, round(r.score, 9)) for r in df.collect())


def _oracle(kind, k):
    return small_oracle.run(small_oracle.search_sql(kind, k), _entries(), list(enumerate(QUERIES)))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_keyword_matches_sql(corpus, queries, k):
    assert _rows(keyword_search(corpus.keyword, queries, k)) == _oracle("keyword", k)


@pytest.mark.parametrize("k", [2, 5])
def test_semantic_matches_sql(corpus, queries, k):
    assert _rows(semantic_search(corpus, queries, k)) == _oracle("semantic", k)


@pytest.mark.parametrize("k", [2, 4])
def test_hybrid_matches_sql(corpus, queries, k):
    assert _rows(hybrid_search(corpus, queries, k)) == _oracle("hybrid", k)


@pytest.mark.parametrize("k", [1, 3])
def test_fuzzy_matches_sql(corpus, queries, k):
    assert _rows(fuzzy_search(corpus, queries, k)) == _oracle("fuzzy", k)


def test_keyword_only_corpus_uses_normalised_query(spark, queries):
    c = build_corpus_index(spark.createDataFrame(_entries(), SCHEMA), with_vectors=False)
    assert _rows(fuzzy_search(c, queries, 3)) == _oracle("keyword_only", 3)


def test_keyword_score_by_hand(spark):
    """Text words count 1, words inside the name 2, inside the documentation 1.5."""
    e = [(1, "mul_ab", "multiply ab", "fn f"), (2, "ab", None, "sig"), (3, "zzz", "zab", "name")]
    df = spark.createDataFrame(e, "entry_pos long, name string, documentation string, signature string")
    df = df.withColumns({c: F.array().cast("array<string>") for c in ("requires_clauses", "ensures_clauses")})
    q = spark.createDataFrame([(1, "ab"), (2, "AB mul ab"), (3, "name"), (4, " . "), (5, None)], "query_id long, query string")
    got = {(r.query_id, r["rank"]): (r.entry_pos, r.score) for r in keyword_search(keyword_index(df), q, 3).collect()}
    assert got == {
        (1, 1): (1, 1 + 2 + 1.5), (1, 2): (2, 1 + 2.0), (1, 3): (3, 1.5),  # a word of the text / inside words only
        (2, 1): (1, 1 + 2 + 1.5 + 2 + 1.5), (2, 2): (2, 3.0), (2, 3): (3, 1.5),  # "mul" stands inside mul_ab and multiply
        (3, 1): (1, 1.0), (3, 2): (2, 1.0), (3, 3): (3, 1.0),  # the label of every text
    }


def _random_corpus(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcde"), int(rng.integers(1, 5))))
    text = lambda m: " ".join(word() for _ in range(m))
    return [dict(entry_pos=int(p), name=f"{word()}_{word()}", documentation=None if p % 7 == 0 else text(int(rng.integers(0, 6))),
                 signature=text(3), requires_clauses=[text(2)] * int(p % 3), ensures_clauses=[]) for p in rng.permutation(n) * 3], text


def test_any_cut_gives_equal_results(spark, monkeypatch):
    """1 query, all queries, small buckets, shards and blocks: the same rows, equal to the SQL."""
    entries, text = _random_corpus(spark, 150)
    asked = [(i, text(4)) for i in range(40)]
    cols = SCHEMA.replace("file_path string, line_number int, ", "").replace(", symbol_id string, source string", "")
    df, q = spark.createDataFrame(entries, cols), spark.createDataFrame(asked, "query_id long, query string")
    want = {k: small_oracle.run(small_oracle.search_sql(k, 7), entries, asked) for k in ("keyword", "semantic", "fuzzy")}
    one = build_corpus_index(df)
    assert _rows(keyword_search(one.keyword, q, 7)) == want["keyword"]
    assert _rows(semantic_search(one, q, 7)) == want["semantic"]
    assert _rows(keyword_search(one.keyword, q.where("query_id = 3"), 7)) == [r for r in want["keyword"] if r[0] == 3]
    monkeypatch.setattr(Q, "BUCKET_QUERIES", 9)
    monkeypatch.setattr(keyword, "SHARD_ENTRIES", 40)
    monkeypatch.setattr(keyword, "BLOCK", 8)
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 16)
    many = build_corpus_index(df)
    assert prepare_queries(q, ["query_id"], "query", 256).buckets == 5 and many.keyword.shards == 4
    assert _rows(keyword_search(many.keyword, q, 7)) == want["keyword"]
    assert _rows(semantic_search(many, q, 7)) == want["semantic"]
    assert _rows(fuzzy_search(many, q, 7)) == want["fuzzy"]


def test_many_queries_equal_few(spark, corpus):
    """A large batch: each query's rows are those it has on its own."""
    n = 12_000
    q = spark.range(n).select(F.col("id").alias("query_id"), F.element_at(
        F.array(*map(F.lit, QUERIES)), (F.col("id") % len(QUERIES) + 1).cast("int")).alias("query"))
    hits = keyword_search(corpus.keyword, q, 2).unionByName(semantic_search(corpus, q, 2))
    spread = hits.groupBy((F.col("query_id") % len(QUERIES)).alias("query_id"), "rank", "entry_pos", "name", "score").count()
    got = spread.collect()
    want = sorted(_oracle("keyword", 2) + _oracle("semantic", 2))
    assert sorted((r.query_id, r["rank"], r.entry_pos, r.name, round(r.score, 9)) for r in got) == want
    assert sum(r["count"] for r in got) == sum(len(range(w[0], n, len(QUERIES))) for w in want)


def test_no_nested_loop_and_no_collect_in_the_plan(corpus, queries):
    plan = fuzzy_search(corpus, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_inputs(spark, corpus, queries):
    assert _rows(fuzzy_search(corpus, queries.limit(0), 3)) == []
    empty = build_corpus_index(spark.createDataFrame([], SCHEMA))
    assert _rows(fuzzy_search(empty, queries, 3)) == []
    assert _rows(keyword_search(empty.keyword, queries, 3)) == []


def test_block_bounds_stop_early(monkeypatch):
    """Blocks below the running n-th best are not scored, and the result is that of a full scan."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    size, n_terms = 2048, 12
    posting = [np.sort(rng.choice(size, 400, replace=False)) for _ in range(n_terms)]
    flags = [rng.choice([1, 1, 1, 1, 1, 1, 1, 7], 400) for _ in posting]
    sent = [0, 1, 2, 5, 9]  # a shard gets the postings of its bucket's terms
    rows = pa.table({
        "kind": [1] + [2] * len(sent), "terms": [None] + [[f"t{i}"] for i in sent],
        "places": [None] + [(posting[i] * 8 + flags[i]).tolist() for i in sent], "positions": [list(range(size))] + [None] * len(sent),
        "names": [[f"n{i}" for i in range(size)]] + [None] * len(sent)})
    asked = pa.table({"key_query_id": [1, 2], "terms": [["t1", "t5"], ["t0", "t2", "t9", "nowhere"]]})
    queries = keyword._Queries(asked, 5)
    shard = keyword._Shard(rows, queries.terms, 2.0, 1.5)
    seen, plain = [], keyword._Shard.scores
    monkeypatch.setattr(keyword._Shard, "scores", lambda self, t, b: (seen.append(len(b)), plain(self, t, b))[1])
    shard.search(queries)
    assert sum(seen) < 2 * size / keyword.BLOCK
    for q, ts in enumerate([[1, 5], [0, 2, 9]]):
        full = np.zeros(size)
        for t in ts:
            full[posting[t]] += np.where(flags[t] == 7, 4.5, 1.0)
        want = np.lexsort((np.arange(size), -full))[:5]
        assert queries.best[q][0].tolist() == want.tolist() and queries.best[q][2].tolist() == full[want].tolist()


@pytest.mark.parametrize("scale", [1, 3.7, 5000])
def test_quantised_bounds_hold(scale):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(60, 48)) * scale, rng.normal(size=(30, 48)) * scale
    a[:20], b[:10] = np.rint(a[:20]), np.rint(b[:10])
    lower, upper = bounds(Coded(a), Coded(b))
    exact = (a @ b.T) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None, :])
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).max() < 0.1


def test_substring_pairs(spark):
    words = ["abc", "ab", "b", "xabcx", "é", "日本語の", "z" * 5000 + "needle", "aaa", "a_1"]
    terms = ["a", "ab", "abc", "abcx", "xabcx", "b", "本語の", "needle", "zneedle", "zzzz", "missing", "aaaa", "_1", "é"]
    index = gram_index(spark.createDataFrame([(w,) for w in words], "word string"))
    assert index.postings.count() <= sum(3 * len(w) for w in words)
    got = {(r.term, r.word) for r in substring_pairs(spark.createDataFrame([(t,) for t in terms], "term string"), index).collect()}
    assert got == {(t, w) for t in terms for w in words if t in w}


def test_term_facts_by_hand(spark, corpus):
    terms = spark.createDataFrame([("mul",), ("multi",), ("x",)], "term string")
    got = {(r.term, r.entry_pos): (r.tok, r.nm, r.dc) for r in term_facts(corpus.keyword, terms).collect()}
    assert got[("mul", 0)] == (0, 1, 0) and got[("multi", 7)] == (0, 0, 1) and got[("multi", 4)] == (0, 1, 1)
    assert got[("x", 1)] == (1, 0, 0) and got[("x", 9)] == (1, 1, 0)


def test_similar_excludes_self_and_unknown(spark, corpus):
    names = spark.createDataFrame([(1, "lemma_mul_comm"), (2, "no_such_name")], "query_id long, name string")
    got = similar_entries(corpus, names, 3).collect()
    assert got and all(r.query_id == 1 and r.name != "lemma_mul_comm" for r in got)
    assert len(got) <= 3


def test_routed_search(spark, corpus):
    q = spark.createDataFrame([(1, "lemma_add_comm"), (2, "lemma_mod_range bound of mod")], "query_id long, query string")
    got = routed_search(corpus, q, 3).collect()
    assert all(r.name != "lemma_add_comm" for r in got if r.query_id == 1)
    assert all(r.name != "lemma_mod_range" for r in got if r.query_id == 2)


def test_routed_search_without_detection(spark, corpus):
    """Without it, a name is searched as typed."""
    q = spark.createDataFrame([(1, "lemma_add_comm"), (2, "lemma_mod_range bound of mod")], "query_id long, query string")
    typed = _rows(routed_search(corpus, q, 3, exclude_self=False, detect_names=False))
    assert typed == _rows(fuzzy_search(corpus, q, 3))
    detected = _rows(routed_search(corpus, q, 3, exclude_self=False))
    assert [r for r in detected if r[0] == 1] == _rows(similar_entries(corpus, q.where("query_id = 1").select(
        "query_id", F.col("query").alias("name")), 3)) != [r for r in typed if r[0] == 1]


def test_retrieval_eval_groups(spark, corpus, queries):
    rows = [(g, qi, name, 0) for g, name, qs in GROUPS for qi in qs]
    expected = spark.createDataFrame(rows, "case string, query_id long, name string, position int")
    hits = fuzzy_search(corpus, queries, 10)
    per_query, summary = retrieval_eval(hits, expected, tolerance=4)
    s = {r.case: (r.passed, r.total) for r in summary.collect()}
    assert set(s) == {g for g, _, _ in GROUPS}
    assert all(t == len(list(qs)) for (g, _, qs) in GROUPS for (p, t) in [s[g]])
    assert per_query.where(F.col("passed")).count() >= 1


def test_model_encoder_hook(spark, corpus, queries):
    """A model-backed encoder (here a toy character-trigram model) plugs in
    as an iterator pandas UDF; cosine search over its vectors matches numpy."""
    from specsift.functions.encode import model_encoder

    def load():
        def f(texts):
            out = np.zeros((len(texts), 32))
            for i, t in enumerate(texts):
                for j in range(len(t) - 2):
                    out[i, sum(map(ord, t[j:j + 3])) % 32] += 1.0
            return out
        return f

    enc = model_encoder(load, 32)
    vec = corpus.entries.select("entry_pos", "name", enc("documentation").alias("v"))
    batch = query_batch(queries.select("query_id", enc("query").alias("v")), ["query_id"])
    got = cosine_topn(vec, batch, 2, 32, corpus_ids="v", kind="dense", query_col="v")
    got = {(r.query_id, r["rank"]): r.entry_pos for r in got.collect()}
    ents = [(r.entry_pos, load()([r.documentation])[0]) for r in corpus.entries.collect()]
    for qi, q in enumerate(QUERIES):
        qvec = load()([q])[0]
        sc = [(-(np.dot(v, qvec) / np.sqrt(np.dot(v, v) * np.dot(qvec, qvec))), p) for p, v in ents
              if np.dot(v, v) > 0 and np.dot(qvec, qvec) > 0]
        want = [p for _, p in sorted(sc)[:2]]
        assert [got.get((qi, 1)), got.get((qi, 2))] == want


def test_all_hits_are_counted_in_their_shards(spark, monkeypatch):
    """Repeated and null keys, positions held twice, any cut: the counts of the plain definition, and no pair is shuffled."""
    entries, text = _random_corpus(spark, 90)
    entries += [dict(entries[3], name="ab_c"), dict(entries[4], documentation="abc abc"),
                dict(entries[5], entry_pos=None), dict(entries[6], entry_pos=1000, name=None)]
    asked = [(i, text(4)) for i in range(12)] + [(3, "ab a"), (None, "a bc"), (None, "a"), (20, None), (21, " . ")]
    cols = SCHEMA.replace("file_path string, line_number int, ", "").replace(", symbol_id string, source string", "")
    df, q = spark.createDataFrame(entries, cols), spark.createDataFrame(asked, "query_id long, query string")
    columns = keyword.keyword_columns(df)
    facts = {}
    for e in columns.where("entry_pos IS NOT NULL AND name IS NOT NULL").collect():  # what the index holds
        facts.setdefault(e.entry_pos, []).append(e)
    want = {}
    for key, query in asked:
        for t in dict.fromkeys((query or "").lower().replace(".", " ").split()):
            for p, es in facts.items():
                hit = [any(t in e.terms for e in es), any(t in e.name.lower() for e in es), any(t in w for e in es for w in e.doc_runs)]
                if any(hit):
                    old = want.get((key, p), (0, 0, 0))
                    want[key, p] = tuple(a + b for a, b in zip(old, hit))

    def got(index):
        rows = keyword.keyword_hits(index, q).collect()
        out = {(r.query_id, r.entry_pos): (r.tok, r.nm, r.dc) for r in rows}
        assert len(out) == len(rows)
        return out

    assert got(keyword.index_keywords(columns)) == want
    for name, value in (("SHARD_ENTRIES", 20), ("BLOCK", 8), ("AT_ONCE", 16), ("TASK_PAIRS", 64), ("POSTING_ROWS", 5)):
        monkeypatch.setattr(keyword, name, value)
    monkeypatch.setattr(Q, "BUCKET_QUERIES", 4)
    index = keyword.index_keywords(columns)
    assert index.shards > 3 and got(index) == want
    plan = keyword.keyword_scores(index, q)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
