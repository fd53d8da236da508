"""Steps that a large batch or corpus goes through: scored together, hashed in Arrow, normalised in one pass."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specsift.functions.encode import hashed_ids, token_ids, window_hashes
from specsift.operators import keyword
from specsift.operators.blend import max_normalize
from specsift.operators.queries import meet, query_batch
from specsift.plans.evaluate import retrieval_eval
from specsift.plans.search import first_named, lookup_by_name


def _shard(rng, size, n_terms):
    places = []
    for i in range(n_terms):
        at = np.sort(rng.choice(size, int(rng.integers(1, size)) if i % 3 else 2, replace=False))
        places.append((at * 8 + rng.choice([1, 2, 3, 5, 7], len(at))).tolist())
    return pa.table({
        "kind": [1] + [2] * n_terms, "terms": [[]] + [[f"t{i}", f"t{(i + 1) % n_terms}"] for i in range(n_terms)],
        "places": [[]] + places, "positions": [list(range(size))] + [[]] * n_terms,
        "names": [[f"n{i}" for i in range(size)]] + [[]] * n_terms})


@pytest.mark.parametrize("boosts", [(2.0, 1.5), (1 / 3, 0.1), (0.0, 0.0)])
@pytest.mark.parametrize("shared", [0, 200, 1 << 40])
def test_together_equals_one_by_one(monkeypatch, boosts, shared):
    rng = np.random.default_rng(3)
    asked = pa.table({"key_query_id": list(range(90)), "terms": [
        [f"t{i}" for i in rng.choice(50, int(rng.integers(0, 30)), replace=False)] for _ in range(90)]})
    monkeypatch.setattr(keyword, "SHARED_POSTINGS", shared)
    monkeypatch.setattr(keyword, "CHUNK", 32)
    monkeypatch.setattr(keyword, "AT_ONCE", 300)
    found = []
    for together in (1, 1 << 30):
        monkeypatch.setattr(keyword, "TOGETHER", together)
        queries = keyword._Queries(asked, 7)
        for seed, size in enumerate((300, 5, 130)):  # bars of the first shards hold in the next
            keyword._Shard(_shard(np.random.default_rng(seed), size, 40), queries.terms, *boosts).search(queries)
        found.append([None if b is None else (b[0].tolist(), b[2].tolist()) for b in queries.best])
    assert found[0] == found[1] and any(b and len(b[0]) == 7 for b in found[0])


def test_equal_scores_keep_the_first_entries():
    score = np.array([[1.0, 2.0, 1.0, 1.0, 2.0], [0.0, 0.0, 3.0, 0.0, 0.0], [5.0, 5.0, 5.0, 5.0, 5.0]])
    kept = keyword._first_n(score, np.array([0.0, 0.0, 6.0]), 3)
    assert [np.flatnonzero(k).tolist() for k in kept] == [[0, 1, 4], [2], []]


def test_max_normalize_reads_its_input_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 0.0), (None, 1.0)], "query_id long, score double").coalesce(1)
    got = max_normalize(df.mapInArrow(counted, df.schema), ["query_id"]).collect()
    assert sorted((r.query_id, r.score, r.norm) for r in got) == [(1, 2.0, 0.5), (1, 4.0, 1.0), (2, 0.0, 0.0)]
    assert runs.value == 4


def test_met_rows_have_no_null_lists(spark):
    batch = query_batch(spark.createDataFrame([(1, ["a"]), (2, None)], "query_id long, terms array<string>"), ["query_id"])
    corpus = spark.createDataFrame([(0, 1, 0, 0, [7])], "shard long, kind int, grp int, bucket int, places array<long>")
    rows = meet(batch, ["terms"], corpus, 1).collect()
    assert len(rows) == 3 and all(r.terms is not None and r.places is not None for r in rows)


def test_token_ids_by_hand(spark):
    def signed(word):
        h = hashlib.md5(word.encode()).hexdigest()
        return (int(h[:8], 16) % 64 + 1) * (-1 if int(h[8], 16) % 2 else 1)

    rows = [(0, ["a", "times", "b", "a"]), (1, None), (2, []), (3, ["iff", "é", "modulo"]), (4, ["leq"])]
    df = spark.createDataFrame(rows, "i int, t array<string>").coalesce(1)
    got = {r.i: (r.plain, r.rewritten) for r in df.select(
        "i", token_ids(F.col("t"), 64).alias("plain"), token_ids(F.col("t"), 64, rewrite=True).alias("rewritten")).collect()}
    ids = lambda words: [signed(w) for w in words]
    assert got == {0: (ids(["a", "times", "b", "a"]), ids("aba")), 1: (None, None), 2: ([], []),
                   3: (ids(["iff", "é", "modulo"]), ids(["if", "and", "only", "if", "é", "mod"])), 4: (ids(["leq"]), [])}
    texts = spark.createDataFrame([("A b, a",), (None,)], "x string")
    assert [r[0] for r in texts.select(hashed_ids("x", 64)).collect()] == [ids("aba"), None]


def test_only_asked_names_are_sorted(spark):
    entries = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (None, "c"), (9, "c")], "entry_pos long, name string")
    names = spark.createDataFrame([("a",), ("a",), ("c",), ("x",), (None,)], "q string")
    first = first_named(entries, names, "q")
    assert sorted((r.name, r.entry_pos) for r in first.collect()) == [("a", 1), ("c", None)]
    assert "LeftSemi" in first._jdf.queryExecution().optimizedPlan().toString()
    found = lookup_by_name(entries, names, "q").collect()
    assert sorted((r.name, r.entry_pos or 0) for r in found) == [("a", 1), ("a", 1), ("c", 0)]


def test_evaluation_reads_the_expected_rows_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    schema = "case string, query_id long, name string, position int"
    expected = spark.createDataFrame([("c", 1, "x", 0), ("c", 1, "y", 0), ("d", 2, "x", 0)], schema).coalesce(1)
    hits = spark.createDataFrame([(1, 2, "x"), (1, 9, "y")], "query_id long, rank int, name string")
    per_query, summary = retrieval_eval(hits, expected.mapInArrow(counted, schema))
    assert sorted((r.name, r.query_id, r.position_found, r.passed) for r in per_query.collect()) == [
        ("x", 1, 1, True), ("x", 2, None, False), ("y", 1, 8, False)]
    assert sorted((r["case"], r.passed, r.total) for r in summary.collect()) == [("c", 1, 2), ("d", 0, 1)]
    assert runs.value == 3


def test_window_hashes(spark):
    rows = [(0, "a b c a b".split()), (1, ["b"]), (2, []), (3, None), (4, "c a b".split()), (5, "b a".split())]
    df = spark.createDataFrame(rows, "i int, w array<string>").coalesce(1)
    got = {r.i: r.h for r in df.select("i", window_hashes(F.col("w"), 2).alias("h")).collect()}
    assert [len(got[i] or []) for i in range(6)] == [4, 0, 0, 0, 2, 1]
    assert got[0][0] == got[0][3] == got[4][1] and got[0][2] == got[4][0] and got[5][0] not in got[0]
    assert {got[0][0]} == {df.where("i = 0").select(window_hashes(F.slice("w", 1, 2), 2).getItem(0)).first()[0]}
