"""Declaration extraction, definition resolution and the build job."""

import json
import os

from pyspark.sql import functions as F

from specsift.functions.extract import declarations, extraction_status
from specsift.operators.resolve import definition_map
from specsift.plans.build import build_corpus, line_origin_stats, merge_corpora
from specsift.sources.dump import read_symbol_dump, read_symbol_dump_lines

TOP = """use vstd::prelude::*;
pub proof fn lemma_add(x: int, y: int)
    requires
        x > 0,
        y > 0,
    ensures
        x + y > 0,
{
}
proof fn lemma_nodoc(a: nat)
    ensures a >= 0
{ }
"""
MACRO = """prove! {
    pub proof fn lemma_in_macro(x: u64)
        requires x < 10
        ensures x * 2 < 20, f(x, 1) == 0
        decreases x
    { }
}
"""
IMPL = """impl Foo {
    pub fn method_a(&self, n: int) -> int
        recommends n > 0
        requires n < 5
    { n }
    spec fn helper(y: int) -> bool;
    proof fn lemma_after(z: int) ensures z == z { }
}
"""


def _decls(spark, files):
    src = spark.createDataFrame(list(files.items()), "file_path string, content string")
    return {(r.file_path, r.name): r for r in declarations(src).collect()}


def test_top_level_and_macro_and_impl(spark):
    d = _decls(spark, {"top.rs": TOP, "macro.rs": MACRO, "impl.rs": IMPL})
    a = d[("top.rs", "lemma_add")]
    assert (a.line_number, list(a.requires), list(a.ensures), a.is_proof) == (2, ["x > 0", "y > 0"], ["x + y > 0"], True)
    b = d[("top.rs", "lemma_nodoc")]
    assert (b.line_number, list(b.requires), list(b.ensures)) == (10, [], ["a >= 0"])
    m = d[("macro.rs", "lemma_in_macro")]
    assert list(m.requires) == ["x < 10"]
    assert list(m.ensures) == ["x * 2 < 20", "f(x", "1) == 0"]  # naive comma split
    assert list(m.decreases) == ["x"]
    i = d[("impl.rs", "method_a")]
    assert (list(i.requires), i.is_proof) == (["n < 5"], False)
    # body-less declaration takes its header up to the next brace
    h = d[("impl.rs", "helper")]
    assert list(h.ensures) == ["z == z"]
    assert d[("impl.rs", "lemma_after")].line_number == 7


def test_first_declaration_wins_and_status(spark):
    files = {"a.rs": "fn f(x: int) requires x > 1 { }\nfn f(y: int) requires y > 2 { }\n", "b.rs": ""}
    src = spark.createDataFrame(list(files.items()), "file_path string, content string")
    d = declarations(src)
    assert [list(r.requires) for r in d.collect()] == [["x > 1"]]
    req = spark.createDataFrame([("a.rs", "f"), ("a.rs", "g"), ("b.rs", "f"), ("c.rs", "f")],
                                "file_path string, name string")
    st = {(r.file_path, r.name): r.status for r in extraction_status(req, src, d).collect()}
    assert st == {("a.rs", "f"): "found", ("a.rs", "g"): "Function not found", ("b.rs", "f"): "empty file",
                  ("c.rs", "f"): "empty file"}


def test_definition_map_last_writer_wins(spark):
    occ = spark.createDataFrame(
        [(0, 0, "a.rs", "s", 1, 4), (1, 0, "b.rs", "s", 1, None), (1, 1, "b.rs", "s", 2, 9), (0, 1, "a.rs", "t", 3, 1)],
        "doc_pos long, occ_pos long, relative_path string, symbol string, symbol_roles int, start_line int")
    m = {r.symbol: (r.def_path, r.def_line) for r in definition_map(occ, ["doc_pos", "occ_pos"]).collect()}
    assert m == {"s": ("b.rs", 5)}  # role 3 is not a definition; line from the last ranged one


def _dump(path):
    doc = {"documents": [
        {"relative_path": "src/lemmas/a.rs",
         "symbols": [
             {"kind": 17, "display_name": "lemma_add", "symbol": "s1", "documentation": ["Adds", "things"],
              "signature_documentation": {"text": "pub proof fn lemma_add(x: int, y: int)",
                                          "relative_path": "src/other.rs"}},
             {"kind": 12, "display_name": "lemma_type", "symbol": "s2"},
             {"kind": 17, "display_name": "helper", "symbol": "s3",
              "signature_documentation": {"text": "fn helper()"}}],
         "occurrences": [{"symbol": "s1", "symbol_roles": 1, "range": [1, 0, 5]}]},
        {"relative_path": "src/main.rs",
         "symbols": [{"kind": 17, "display_name": "lemma_nodoc", "symbol": "s4",
                      "signature_documentation": {"text": "proof fn lemma_nodoc(a: nat)"}}],
         "occurrences": [{"symbol": "s4", "symbol_roles": 1, "range": []},
                         {"symbol": "s1", "symbol_roles": 2, "range": [7]}]}]}
    with open(path, "w") as f:
        json.dump(doc, f)


def test_build_from_json_dump(spark, scratch):
    _dump(os.path.join(scratch, "dump.json"))
    docs = read_symbol_dump(spark, os.path.join(scratch, "dump.json"))
    src = spark.createDataFrame([("src/lemmas/a.rs", TOP), ("src/main.rs", TOP)], "file_path string, content string")
    built = build_corpus(docs, src, path_prefix=None)  # default keywords: only the 'lemmas' document
    rows = {r.name: r for r in built.collect()}
    assert set(rows) == {"lemma_add"}
    r = rows["lemma_add"]
    assert (r.file_path, r.line_number, r.documentation, r.line_from_dump) == ("src/lemmas/a.rs", 2, "Adds things", True)
    assert list(r.requires_clauses) == ["x > 0", "y > 0"]
    everything = build_corpus(docs, src, path_prefix="")  # empty prefix means all documents
    names = {r.name: r for r in everything.collect()}
    assert set(names) == {"lemma_add", "lemma_nodoc"}
    nd = names["lemma_nodoc"]
    assert (nd.file_path, nd.line_number, nd.line_from_dump) == ("src/main.rs", 10, False)
    st = line_origin_stats(everything).first()
    assert (st.total, st.from_dump, st.from_parsing) == (2, 1, 1)
    merged = merge_corpora(everything.drop("line_from_dump"), built.drop("line_from_dump"))
    assert merged.count() == 3


def test_json_lines_dump(spark, scratch):
    p = os.path.join(scratch, "dump.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"doc_pos": 0, "relative_path": "x/specs.rs", "symbols": [
            {"kind": 17, "display_name": "spec_a", "symbol": "q"}], "occurrences": []}) + "\n")
    docs = read_symbol_dump_lines(spark, p)
    src = spark.createDataFrame([("x/specs.rs", "")], "file_path string, content string")
    assert [r.name for r in build_corpus(docs, src).collect()] == ["spec_a"]
    assert build_corpus(docs, src).where(F.size("requires_clauses") > 0).count() == 0


def test_definition_map_hot_symbol(spark):
    """One symbol with a third of all occurrences resolves to one row (map-side
    partial aggregation), and the last definition wins."""
    rows = [(d, o, f"f{d}.rs", "hot" if o % 3 == 0 else f"s{d}_{o}", 1, o) for d in range(20) for o in range(30)]
    occ = spark.createDataFrame(rows, "doc_pos long, occ_pos long, relative_path string, symbol string, "
                                      "symbol_roles int, start_line int")
    m = definition_map(occ, ["doc_pos", "occ_pos"])
    hot = m.where("symbol = 'hot'").collect()
    assert len(hot) == 1 and (hot[0].def_path, hot[0].def_line) == ("f19.rs", 28)
    assert m.count() == 1 + 20 * 20
