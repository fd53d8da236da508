"""What a large search keeps on disk: small rows between steps, a few copies of the corpus at a time, each written once."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specsift.operators import keyword, queries as Q, vectors
from specsift.operators.qgrams import pairs_within
from specsift.operators.queries import in_waves, prepare_queries, query_batch
from specsift.operators.vectors import matrix, packed
from specsift.plans import search
from specsift.plans.search import build_corpus_index, hybrid_search
from specsift.session import write_stage
from specsift.sources.corpus_io import write_enriched_graph
from test_many_queries import _shard
from test_search import SCHEMA, _entries


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_stage_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffle_files(spark), spark.conf.get(key)
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("v"))
    kept = write_stage(df.repartition(5, "k").groupBy("v").count(), "left")
    assert _shuffle_files(spark) <= before and spark.conf.get(key) == setting
    assert kept.count() == 1000


def test_the_corpus_text_is_not_written_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(search, "materialize", lambda df: (written.append(df.columns), df)[1])
    corpus = build_corpus_index(spark.createDataFrame(_entries(), SCHEMA))
    assert written == [["entry_pos", "name", "terms", "name_runs", "doc_runs", "ids"]]
    assert sorted(map(str, corpus.entries.collect())) == sorted(map(str, spark.createDataFrame(_entries(), SCHEMA).collect()))


def test_a_shard_is_met_as_one_row(spark):
    index = keyword.keyword_index(spark.createDataFrame(_entries(), SCHEMA))
    q = spark.createDataFrame([(i, "mul a b lemma") for i in range(30)], "query_id long, query string")
    batch = prepare_queries(q, ["query_id"], "query", 256)
    met = keyword._met(index, batch, 1)
    assert met.where("shard >= 0").count() == index.shards == 1 and met.where("shard < 0").count() == 30


def test_postings_by_hand(spark):
    rows = [(2, "b a", "a", ""), (1, "a b", "x_a", "b b"), (1, "c", "", ""), (5, None, "q", "q"), (None, "z", "z", "z")]
    rows = [(p, f"n{i}", *[None if x is None else x.split() for x in texts]) for i, (p, *texts) in enumerate(rows)]
    columns = spark.createDataFrame(rows, "entry_pos long, name string, terms array<string>, name_runs array<string>, doc_runs array<string>")
    got = {(r.word, r.run): r.places for r in keyword.index_keywords(columns).postings.collect()}
    at = lambda p, flag: p * keyword.PLACE + flag
    T, N, D = keyword.TEXT, keyword.NAME, keyword.DOC
    assert got == {("a", False): [at(1, T), at(2, T)], ("b", False): [at(1, T), at(2, T)], ("c", False): [at(1, T)],
                   ("a", True): [at(2, N)], ("x_a", True): [at(1, N)], ("b", True): [at(1, D), at(1, D)]}


def test_pairs_within_equal_a_plain_search(monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abé本"), n))
    words = list({word(int(rng.integers(1, 9))) for _ in range(80)}) + ["", "z" * 3000 + "needle"]
    terms = list({word(int(rng.integers(1, 5))) for _ in range(60)}) + ["", "needle", "zz", "missing", "q" * 4000]
    want = {(t, w) for t in range(len(terms)) for w in range(len(words)) if terms[t] and terms[t] in words[w]}
    for pieces in (1 << 22, 7):
        monkeypatch.setattr("specsift.operators.qgrams.PIECES", pieces)
        term, at = pairs_within(pa.array(terms), pa.array(words))
        assert len(term) == len(want) and set(zip(term.tolist(), at.tolist())) == want
    assert [len(x) for x in pairs_within(pa.array([], pa.string()), pa.array(words))] == [0, 0]
    assert [len(x) for x in pairs_within(pa.array(terms), pa.array([], pa.string()))] == [0, 0]


def test_packed_vectors_hold_the_counts(spark):
    rows = [(0, [1, 1, -3, 8]), (1, None), (2, []), (3, [5] * 300 + [-2] * 200), (4, [2, -2]), (5, [7] * 40_000)]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    want = matrix(pa.array([r[1] for r in rows], pa.list_(pa.int32())), 8, "ids")
    for parts in (1, 6):  # rows of one Arrow batch have one width
        got = sorted(df.repartitionByRange(parts, "i").select("i", packed(8)("ids").alias("v")).collect())
        assert [r.v is None for r in got] == [False, True, False, False, False, False]
        assert np.array_equal(matrix(pa.array([None if r.v is None else bytes(r.v) for r in got], pa.binary()), 8, "packed"), want)
    assert {len(r.v) for r in got if r.v is not None} == {8, 16, 32}


@pytest.mark.parametrize("wave", [1, 3, 100])
def test_buckets_meet_the_corpus_a_few_at_a_time(spark, monkeypatch, wave):
    monkeypatch.setattr(Q, "BUCKET_QUERIES", 5)
    monkeypatch.setattr(Q, "WAVE", wave)
    batch = query_batch(spark.range(33).select(F.col("id").alias("query_id"), F.array(F.lit("a")).alias("terms")), ["query_id"])
    seen = []

    def run(part):
        seen.append(part.buckets)
        rows = part.rows.collect()
        assert part.buckets <= wave and {r.bucket for r in rows} <= set(range(part.buckets))
        return part.rows.select("query_id")

    assert sorted(r.query_id for r in in_waves(batch, run, "waves").collect()) == list(range(33))
    assert sum(seen) == batch.buckets == 7


def test_both_lists_of_a_hybrid_search_are_written(spark, monkeypatch):
    names, plain = [], search.write_stage
    corpus = build_corpus_index(spark.createDataFrame(_entries(), SCHEMA))
    corpus.keyword
    monkeypatch.setattr(search, "write_stage", lambda df, name: (names.append(name), plain(df, name))[1])
    q = spark.createDataFrame([(1, "mul a b"), (2, "mod range")], "query_id long, query string")
    assert hybrid_search(corpus, q, 3).count() == 6 and names == ["semantic", "keyword"]


@pytest.mark.parametrize("boosts", [(2.0, 1.5), (1 / 3, 0.1)])
def test_postings_added_in_pieces(monkeypatch, boosts):
    rng = np.random.default_rng(6)
    asked = pa.table({"key_query_id": list(range(40)), "terms": [
        [f"t{i}" for i in rng.choice(45, int(rng.integers(0, 25)), replace=False)] for _ in range(40)]})
    monkeypatch.setattr(keyword, "SHARED_POSTINGS", 1 << 40)  # no word is a column
    found = []
    for together, added in ((1 << 30, 1), (1, 50), (1, 1 << 20)):
        monkeypatch.setattr(keyword, "TOGETHER", together)
        monkeypatch.setattr(keyword, "ADDED", added)
        queries = keyword._Queries(asked, 6)
        for size in (200, 70):
            keyword._Shard(_shard(np.random.default_rng(size), size, 40), queries.terms, *boosts).search(queries)
        found.append([None if b is None else (b[0].tolist(), b[2].tolist()) for b in queries.best])
    assert found[0] == found[1] == found[2] and any(b and len(b[0]) == 6 for b in found[0])


@pytest.mark.parametrize("long", [3, 200, 40_000])
def test_cosines_of_counts_are_exact(long):
    """Rounded products, and those of rows too long to round, equal the plain cosines; of equal ones the first stay."""
    rng = np.random.default_rng(long)
    e, q = rng.integers(-long, long, (90, 16)), rng.integers(-long, long, (11, 16))
    e[40:60], e[7], q[3], position = e[10:30], 0, 0, rng.permutation(90)
    best = vectors._Best(pa.table({"key_query_id": list(range(11)), "vector": list(q.astype(float))}), 6, 16, "dense")
    for lo in range(0, 90, 30):
        best.offer(vectors.Coded(e[lo : lo + 30].astype(float)), position[lo : lo + 30], [])
    for i in range(11):
        with np.errstate(invalid="ignore"):
            cosine = (e @ q[i]) / np.sqrt((e * e).sum(1).astype(float) * float((q[i] * q[i]).sum()))
        want = [j for j in np.lexsort((position, -cosine)) if e[j].any() and q[i].any()][:6]
        own = best.q == i
        assert best.position[own].tolist() == position[want].tolist() and best.score[own].tolist() == cosine[want].tolist()


def test_enriched_nodes_are_read_once(spark, scratch):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    rows = [(1, '{"a": 1}', None), (0, "{}", [("x", 0.5)])]
    df = spark.createDataFrame(rows, "node_id long, node string, similar_lemmas array<struct<name:string,score:double>>").coalesce(1)
    write_enriched_graph(df.mapInArrow(counted, df.schema), os.path.join(scratch, "g"))
    lines = [r.value for r in spark.read.text(os.path.join(scratch, "g", "nodes")).collect()]
    assert lines == ['{"similar_lemmas": [{"name": "x", "score": 0.5}]}', '{"a": 1}'] and runs.value == 2
