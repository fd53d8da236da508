"""Lexical search against a plain scan of all documents."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from specsift.llm import lexical

from brute import alnum

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, n int, score int", "item_id string, text string, rank int"


def brute(docs, items, k=10):
    """docs: (id, text); items: (id, text) -> sorted rows (item, rank, doc, score)."""
    held = [(d, t, Counter(t)) for d, t in ((d, alnum(t)) for d, t in docs) if t]
    big_n, big_l = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, t, c in held:
            m = 25 + 75 * len(t) * big_n // big_l
            score = 0
            for q in alnum(text):
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[q] + 1))) if q in c else 0
                score += w * (1000000000 * c[q] // (1000 * c[q] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=10):
    left = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    found = lexical.search(left, right, k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=str)


def words(rng, n, size=60):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % size)


@pytest.mark.parametrize("postings", [2_000_000, 200, 1])
def test_equals_scan(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical, "DEPTH", 2)
    rng = np.random.default_rng(11)
    docs = [(i, words(rng, int(rng.integers(1, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties far beyond ten
    docs += [(2000, None), (2001, ""), (2002, " .,! "), (None, docs[5][1]), (None, "w1 w2"), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(3000, "É É é w1-W2_w3 straße İ"), (3001, "w1 " * 30_000), (-5, docs[5][1])]
    items = [(f"i{j}", words(rng, 12)) for j in range(15)] + [("copy", docs[5][1]), ("rep", "w1 w1 w1 w9 w9"), ("rep", "w1 w1 w1 w9 w9")]
    items += [("none", None), ("empty", ""), ("unknown", "nowhere else"), ("high", "É straße i̇"), ("clash", "w2.W3"), (None, "w4 w5")]
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_TERMS", 5)
    rng = np.random.default_rng(2)
    docs = [(i, words(rng, 20)) for i in range(80)]
    items = [(f"i{j}", words(rng, 4)) for j in range(12)]
    assert run(spark, docs, items, k=3) == brute(docs, items, k=3)


def test_empty_tables(spark):
    assert run(spark, [], [("a", "w1")]) == []
    assert run(spark, [(1, "w1")], []) == []
    assert run(spark, [(1, None)], [("a", "w1")]) == []
    assert run(spark, [(1, "w1")], [("a", "w1")]) == brute([(1, "w1")], [("a", "w1")])


def test_query_equals_scan(spark):
    from specsift.llm.queries import op11_lexical_search

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = op11_lexical_search(spark, SF).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=str) == brute(docs, items)


def test_stops_early_but_never_at_the_kth():
    """Best positions stop before the lists end; ties of the k-th are all returned."""
    rng = np.random.default_rng(4)
    n, terms = 20_000, 6
    lists = [np.sort(rng.choice(terms, rng.integers(1, 4), replace=False)) for _ in range(n)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    term = np.concatenate(lists)
    impact = (rng.pareto(1.0, len(term)) * 50).astype(np.int64) + 1
    shard = lexical.ImpactShard(first, term, impact, terms)
    repeats = np.array([1, 2, 1])
    doc, score, accessed = shard.best(np.array([0, 2, 5]), repeats, 10)
    weight = np.array([1, 0, 2, 0, 0, 1])
    full = np.add.reduceat(impact * weight[term], first[:-1])
    kth = np.sort(full)[-10]
    want = defaultdict(int, {int(d): int(full[d]) for d in np.flatnonzero(full >= kth)})
    assert {int(d): int(s) for d, s in zip(doc, score)} == want
    assert accessed < n / 4
