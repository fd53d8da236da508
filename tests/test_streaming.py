"""The streaming search service returns what the batch plan returns."""

import json
import os

from specsift.plans.search import build_corpus_index, fuzzy_search
from specsift.streaming.search_stream import start_search_stream


def test_stream_equals_batch(spark, scratch):
    ents = spark.createDataFrame(
        [(i, f"lemma_{w}", "f.rs", 1, f"about {w}", "fn x()", [f"{w} > 0"], [], f"s{i}", "project")
         for i, w in enumerate(["mod", "div", "mul", "add", "sub"])],
        "entry_pos long, name string, file_path string, line_number int, documentation string, signature string, "
        "requires_clauses array<string>, ensures_clauses array<string>, symbol_id string, source string")
    corpus = build_corpus_index(ents)
    qdir = os.path.join(scratch, "queries")
    os.makedirs(qdir)
    qs = [(1, "x mod m"), (2, "a times b when b > 0"), (3, "add things")]
    with open(os.path.join(qdir, "q1.json"), "w") as f:
        f.write("\n".join(json.dumps({"query_id": i, "query": q}) for i, q in qs))
    out = os.path.join(scratch, "out")
    s = start_search_stream(spark, corpus, qdir, out, k=3, checkpoint=os.path.join(scratch, "ckpt"),
                            available_now=True)
    s.awaitTermination(300)
    got = sorted((r.query_id, r.rank, r.name) for r in spark.read.parquet(out).collect())
    batch = fuzzy_search(corpus, spark.createDataFrame(qs, "query_id long, query string"), 3)
    assert got == sorted((r.query_id, r.rank, r.name) for r in batch.collect())
