"""Nearest labelled examples over whole texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specsift.llm import toxicity
from specsift.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    """40 clean and 6 toxic examples of words of their own, then texts without a label."""
    own = lambda kind, i: " ".join(f"{kind}{i}x{j}" for j in range(12))
    texts = {i: own("clean", i) for i in range(40)} | {100 + i: own("toxic", i) for i in range(6)} | {200: "", 201: None}
    labels = [(i, int(100 <= i < 200)) for i in texts]
    more = {300: own("toxic", 3), 301: own("clean", 7), 302: "nothing known", 303: None}
    docs = spark.createDataFrame([*texts.items(), *more.items()], "doc_id long, text string")
    return {r.doc_id: r for r in score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, label int")).collect()}


def test_a_copy_of_a_rare_toxic_example_finds_it(scored):
    assert scored[300].nearest[0] == 103
    assert scored[300].cosines[0] == pytest.approx(1)


def test_clean_examples_are_neighbours(scored):
    assert scored[301].nearest[0] == 7
    assert scored[301].score < scored[300].score


def test_texts_without_known_terms(scored):
    assert len(scored) == 52
    assert [scored[i].nearest for i in (200, 201, 302, 303)] == [[]] * 4


def terms(text):
    """Lower-cased words and their first 3 to 8 bytes (those longer than that), with repeats."""
    out = []
    for word in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode()):
        word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        out += [word] + [(n, word[:n]) for n in range(3, 9) if len(word) > n]
    return out


def brute(docs, labels, k=toxicity.NEIGHBOURS):
    """{doc_id: [(example, cosine)]} by plain cosines; docs and labels: id -> value, ids distinct."""
    n = len(docs)
    count = {d: Counter(terms(t)) for d, t in docs.items()}
    df = Counter(t for c in count.values() for t in c)
    known = {t for d in labels if labels[d] is not None for t in count[d]}
    vector = {}
    for d, c in count.items():
        v = {t: (1 + math.log(f)) * math.log((n + 1) / (df[t] + 1)) for t, f in c.items() if t in known}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vector[d] = {t: x / norm for t, x in v.items()} if norm else v
    out = {}
    for d, v in vector.items():
        found = []
        for e in labels:
            if labels[e] is not None and vector[e]:
                c = round(sum(x * vector[e].get(t, 0) for t, x in v.items()), toxicity.DIGITS)
                found.append((-c, e))
        out[d] = [(e, -c) for c, e in sorted(found)[:k] if c < 0]
    return out


def test_neighbours_equal_plain_cosines(spark, monkeypatch):
    """All documents of the smallest tables, in small blocks: the three nearest and their cosines."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "GROUP", 2)
    monkeypatch.setattr(toxicity, "DENSE_TERMS", 64)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    texts, marks = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.label for r in labels.collect()}
    want = brute(texts, {d: y for d, y in marks.items() if d in texts}, 3)
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert got.keys() == want.keys()
    for d, r in got.items():
        assert np.allclose(r.cosines, [c for _, c in want[d]], atol=2e-6), d
        clear = [i for i, (_, c) in enumerate(want[d]) if all(abs(c - o) > 4e-6 for j, (_, o) in enumerate(want[d]) if j != i)]
        assert all(r.nearest[i] == want[d][i][0] for i in clear if i < 2)


def test_blocks_are_skipped_and_nothing_is_lost():
    """Topics of words of their own: far blocks are not multiplied; the result is the full scan's."""
    rng = np.random.default_rng(9)
    idf, vectors = rng.uniform(1, 3, 8 * 200), []
    for i in range(2048):
        at = np.unique(rng.integers(0, 200, 30) + 200 * (i % 8))
        vectors.append((at, rng.integers(1, 4, len(at)).astype(float)))
    weighted = [(at.astype("<i4"), toxicity.weigh(idf, at, times).astype("<f4")) for at, times in vectors]
    sketches = np.array([toxicity.sketch(*v) for v in weighted])
    index = toxicity.build_index(idf, np.arange(2048)[::-1], np.zeros(2048), np.ones(2048), weighted, sketches)
    plain = np.zeros((2048, len(idf)))
    for i, (at, weights) in enumerate(weighted):
        plain[2047 - i, at] = weights  # by id
    searcher = toxicity.Searcher(index)
    asked = [(at, toxicity.weigh(idf, at, times)) for at, times in vectors[:64]]
    for i, (found, cosines) in enumerate(searcher.nearest(asked, 15)):
        full = np.round(plain[:, asked[i][0]] @ asked[i][1], toxicity.DIGITS)
        want = np.lexsort((np.arange(2048), -full))[:15]
        assert np.allclose(cosines, full[want], atol=1.1e-6)
    assert searcher.visited < 0.5 * searcher.of


def test_sums_read_packed_postings_and_bounded_products(monkeypatch):
    """CPU time: a sparse posting is one read of eight bytes, terms without a column
    hold no row of columns, and exact cosines of a batch are summed together, in parts."""
    rng = np.random.default_rng(4)
    idf, vectors = rng.uniform(1, 3, 3000), []
    for _ in range(1200):
        at = np.unique((rng.zipf(1.2, 60) - 1) % 3000)
        vectors.append((at, rng.integers(1, 4, len(at)).astype(float)))
    weighted = [(at.astype("<i4"), toxicity.weigh(idf, at, times).astype("<f4")) for at, times in vectors]
    sketches = np.array([toxicity.sketch(*v) for v in weighted])
    monkeypatch.setattr(toxicity, "DENSE_TERMS", 100)
    index = toxicity.build_index(idf, np.arange(1200), np.zeros(1200), np.ones(1200), weighted, sketches)
    searcher = toxicity.Searcher(index)
    groups = len(searcher.edges) - 1
    assert searcher.postings.itemsize == 8 and searcher.columns.shape == (100 * groups,)
    assert len(searcher.postings) + int((searcher.matrix > 0).sum()) == len(index.terms)
    none = (np.zeros(0, np.int64), np.zeros(0))
    asked = [none, *[(at, toxicity.weigh(idf, at, times)) for at, times in vectors[:70]], none]
    whole = searcher.nearest(asked, 15)
    plain = np.zeros((1200, 3000))
    for i, (at, weights) in enumerate(weighted):
        plain[i, at] = weights
    for (at, weights), (found, cosines) in zip(asked, whole):
        full = np.round(plain[:, at] @ weights, toxicity.DIGITS)
        assert np.allclose(cosines, np.sort(full)[::-1][: len(cosines)], atol=1.1e-6)
        assert np.allclose(full[index.ids[found]], cosines, atol=1.1e-6) and len(cosines) == min(15, int((full > 0).sum()))
    monkeypatch.setattr(toxicity, "PRODUCTS", 7)
    for one, other in zip(whole, searcher.nearest(asked, 15)):
        assert np.array_equal(one[0], other[0]) and np.array_equal(one[1], other[1])


def test_scores_do_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    one = sorted(map(tuple, score_toxicity(docs.coalesce(1), labels).collect()))
    assert one == sorted(map(tuple, score_toxicity(docs.repartition(7), labels).collect()))


def test_repeats_clashes_nulls_and_empty_tables(spark):
    rows = [(1, "vile words here", 0), (1, "vile words here", 1), (2, "kind words there", 1), (None, "vile words", 3), (3, None, 4), (4, "", 5)]
    schema = "doc_id long, text string, label int"
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows], schema + ", score double, terms int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id long, label int")
    got = score_toxicity(docs, labels).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 2, 3, 4]
    ones = [r for r in got if r.doc_id == 1]
    assert ones[0] == ones[1] and ones[0].nearest[0] == 1
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), labels).collect() == []
    assert score_toxicity(docs.limit(0), labels.limit(0)).collect() == []


def test_ties_rank_by_example_id_and_long_texts_are_whole(spark):
    texts = {i: "same words in each" for i in range(40)} | {50: "other things"} | {60: "filler " * 60_000 + "same words in each"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, 0)], "doc_id long, label int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert got[7].nearest == [0, 1, 2] and got[60].nearest == [0, 1, 2]
