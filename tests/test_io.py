"""Sources and sinks round-trip in fresh scratch folders."""

import json
import os

from pyspark.sql import functions as F

from specsift.plans.audit import write_duplicate_report
from specsift.plans.graph import enrich_graph
from specsift.plans.search import build_corpus_index
from specsift.sources.corpus_io import (read_call_graph, read_corpus, read_index_json, write_corpus,
                                        write_enriched_graph)

ENTRIES = [
    {"name": "lemma_a", "file_path": "a.rs", "line_number": 3, "documentation": "adds", "signature": "fn a()",
     "requires_clauses": ["x > 0"], "ensures_clauses": ["y > 0"], "symbol_id": "s1", "source": "project"},
    {"name": "lemma_b", "file_path": "b.rs", "line_number": None, "documentation": "", "signature": "fn b()",
     "requires_clauses": [], "ensures_clauses": [], "symbol_id": "s2"},
]


def test_index_json_and_native_corpus(spark, scratch):
    p = os.path.join(scratch, "index.json")
    with open(p, "w") as f:
        json.dump({"version": "1.0", "repo_root": "/r", "lemmas": ENTRIES, "has_embeddings": False}, f)
    e = read_index_json(spark, p)
    rows = e.orderBy("entry_pos").collect()
    assert [(r.entry_pos, r.name, r.source) for r in rows] == [(0, "lemma_a", "project"), (1, "lemma_b", "project")]
    c = build_corpus_index(e)
    write_corpus(e, os.path.join(scratch, "corpus"), c.vectors, repo_root="/r")
    e2, v2 = read_corpus(spark, os.path.join(scratch, "corpus"))
    assert e2.count() == 2 and v2 is not None and v2.count() == 2
    assert e2.where(F.col("source") == "project").count() == 2
    write_corpus(e, os.path.join(scratch, "novec"))
    assert read_corpus(spark, os.path.join(scratch, "novec"))[1] is None


def test_call_graph_round_trip(spark, scratch):
    p = os.path.join(scratch, "graph.json")
    with open(p, "w") as f:
        json.dump({"nodes": [{"display_name": "lemma_a", "body": "x > 0\ny > 0", "id": 7},
                             {"display_name": "", "body": "skip me"},
                             {"display_name": "zzz_unrelated", "extra": [1, 2]}, {}], "edges": [[0, 1], [1, 2]], "root": "r"}, f)
    nodes = read_call_graph(spark, p)
    assert nodes.count() == 4
    corpus = build_corpus_index(read_index_json_rows(spark, scratch))
    enriched = enrich_graph(corpus, nodes, 1)
    out = os.path.join(scratch, "out")
    write_enriched_graph(enriched, out, source=p)
    lines = [json.loads(r.value) for r in spark.read.text(f"{out}/nodes").collect()]
    assert len(lines) == 4 and lines[3] == {}
    assert [json.loads(r.value) for r in spark.read.text(f"{out}/edges").collect()] == [[0, 1], [1, 2]]
    assert [json.loads(r.value) for r in spark.read.text(f"{out}/header").collect()] == [{"root": "r"}]
    assert lines[1] == {"display_name": "", "body": "skip me"}  # untouched
    hit = lines[0]
    assert hit["id"] == 7 and hit["similar_lemmas"][0]["name"] == "lemma_b"


def test_enriched_graph_sets_the_key_once(spark, scratch):
    """An empty node and a node that already has the key stay valid JSON."""
    rows = [(0, "{}", [("a", 0.5)]), (1, '{"similar_lemmas": [], "k": "é"}', [("b", 0.25)])]
    df = spark.createDataFrame(rows, "node_id long, node string, similar_lemmas array<struct<name:string,score:double>>")
    write_enriched_graph(df, os.path.join(scratch, "g"))
    lines = [json.loads(r.value) for r in spark.read.text(os.path.join(scratch, "g", "nodes")).collect()]
    assert lines == [{"similar_lemmas": [{"name": "a", "score": 0.5}]},
                     {"similar_lemmas": [{"name": "b", "score": 0.25}], "k": "é"}]


def test_index_shards_keep_positions_with_gaps(spark, scratch):
    from specsift.sources.corpus_io import read_index_shards, write_index_shards

    rows = [(p, f"n{p}", "a.rs", 1, "", "", [], [], "", "project") for p in (0, 2, 999, 1000, (3 << 24) + 5, (3 << 24) + 9)]
    schema = ("entry_pos long, name string, file_path string, line_number int, documentation string, signature string, "
              "requires_clauses array<string>, ensures_clauses array<string>, symbol_id string, source string")
    write_index_shards(spark.createDataFrame(rows, schema), os.path.join(scratch, "shards"))
    back = read_index_shards(spark, os.path.join(scratch, "shards")).collect()
    assert sorted((r.entry_pos, r.name) for r in back) == [(r[0], r[1]) for r in rows]


def read_index_json_rows(spark, scratch):
    p = os.path.join(scratch, "idx2.json")
    with open(p, "w") as f:
        json.dump({"lemmas": ENTRIES}, f)
    return read_index_json(spark, p)


def test_duplicate_report_files(spark, scratch):
    pairs = spark.createDataFrame([("exact", "a", "b", 0.9, 6, "a.rs", "b.rs")],
                                  "type string, lemma1 string, lemma2 string, similarity double, n_links long, file1 string, file2 string")
    write_duplicate_report(pairs, os.path.join(scratch, "rep"), 0.75, None)
    head = spark.read.json(os.path.join(scratch, "rep", "header")).first()
    assert (head.threshold, head.similar_threshold, head.total) == (0.75, None, 6)  # links, not rows
    assert spark.read.json(os.path.join(scratch, "rep", "duplicates")).count() == 1


def test_read_source_files(spark, scratch):
    from specsift.sources.corpus_io import read_source_files

    os.makedirs(os.path.join(scratch, "src", "sub"))
    for rel, txt in [("src/a.rs", "fn a() {}"), ("src/sub/b.rs", "fn b() {}"), ("src/c.txt", "x"),
                     ("src/a b+c%20.rs", "fn c() {}"), ("src/v1..2.rs", "fn d() {}")]:
        with open(os.path.join(scratch, rel), "w") as f:
            f.write(txt)
    got = sorted((r.file_path, r.content) for r in read_source_files(spark, scratch).collect())
    assert got == [("src/a b+c%20.rs", "fn c() {}"), ("src/a.rs", "fn a() {}"), ("src/sub/b.rs", "fn b() {}"),
                   ("src/v1..2.rs", "fn d() {}")]
