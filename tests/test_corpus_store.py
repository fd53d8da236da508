"""A stored corpus grows by parts: the base is not touched, versions stay, positions never meet."""

import pytest

from specsift.plans.build import merge_corpora
from specsift.plans.search import build_corpus_index, fuzzy_search
from specsift.sources.corpus_store import CorpusStore

SCHEMA = ("entry_pos long, name string, file_path string, line_number int, documentation string, signature string, "
          "requires_clauses array<string>, ensures_clauses array<string>, symbol_id string, source string")


def _entries(spark, rows):
    return spark.createDataFrame([(p, n, "f.rs", None, d, f"fn {n}()", [], ["x times y"], n, s) for p, n, d, s in rows], SCHEMA)


BASE = [(0, "mul_comm", "multiplication commutes", "project"), (7, "add_comm", "addition commutes", "project")]
NEW = [(0, "mul_comm", "other file", "reflib"), (3, "div_bound", "division bound", "reflib")]


def test_versions_and_offsets(spark, scratch):
    store = CorpusStore(spark, f"{scratch}/store")
    assert store.versions() == [] and store.manifest() == []
    assert store.append(_entries(spark, BASE)) == 1
    assert store.append(_entries(spark, NEW)) == 2
    assert store.append(_entries(spark, NEW[:1])) == 3
    got = [(r.entry_pos, r.name, r.source) for r in store.entries().orderBy("entry_pos").collect()]
    assert got == [(0, "mul_comm", "project"), (7, "add_comm", "project"), (8, "mul_comm", "reflib"), (11, "div_bound", "reflib"),
                   (12, "mul_comm", "reflib")]
    assert store.entries(1).count() == 2 and store.entries(2).count() == 4 and store.versions() == [1, 2, 3]
    merged = merge_corpora(_entries(spark, BASE), _entries(spark, NEW))
    assert sorted(map(str, store.entries(2).collect())) == sorted(map(str, merged.select(store.entries(2).columns).collect()))


def test_an_addition_reads_and_writes_nothing_of_the_base(spark, scratch):
    import os

    store = CorpusStore(spark, f"{scratch}/store")
    store.append(_entries(spark, BASE))
    part = store.manifest()[0].part
    os.rename(f"{scratch}/store/parts/{part}", f"{scratch}/away")
    store.append(_entries(spark, NEW))  # the base is not even there
    os.rename(f"{scratch}/away", f"{scratch}/store/parts/{part}")
    assert store.entries().count() == 4 and [r.rows for r in store.manifest()] == [2, 2]


def test_search_equals_an_index_of_all(spark, scratch):
    store = CorpusStore(spark, f"{scratch}/store")
    store.append(_entries(spark, BASE))
    store.append(_entries(spark, NEW))
    q = spark.createDataFrame([(1, "mul commutes"), (2, "division bound x times y")], "query_id long, query string")
    rows = lambda c: sorted((r.query_id, r["rank"], r.entry_pos, r.name, round(r.score, 9)) for r in fuzzy_search(c, q, 3).collect())
    assert rows(store.corpus()) == rows(build_corpus_index(store.entries()))


def test_empty_and_conflicting_additions(spark, scratch):
    store = CorpusStore(spark, f"{scratch}/store")
    with pytest.raises(ValueError):
        store.append(_entries(spark, BASE).limit(0))
    assert store.versions() == []
    store.append(_entries(spark, BASE))
    store.append(_entries(spark, NEW), with_vectors=False)
    assert store.vectors(1) is not None and store.vectors() is None
    with pytest.raises(Exception, match="(?i)exist"):
        spark.createDataFrame([(1,)], "a int").write.mode("errorifexists").json(f"{scratch}/store/manifest/version=2")
