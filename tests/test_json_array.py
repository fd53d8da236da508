"""Large JSON files by byte ranges equal the plain parser, wherever the cuts fall."""

import json
import os

import pytest

from specsift.session import ship_package
from specsift.sources import json_array as J

HARD = [
    {"relative_path": "a.rs", "text": 'quote " brace } bracket ] comma , [ {'},
    {"text": "backslashes \\ \\\\ \\\" end\\", "nested": {"documents": [{"x": "]"}], "deep": [[[]]]}},
    {}, {"é": "日本語 \U0001f600  "}, {"empty": "", "n": -1.5e3, "t": [True, None]}, {"long": "\\" * 41 + '"' * 7},
]


def _write(folder, name, documents, indent=None, before=None):
    obj = {**(before or {"version": "1 [", "skip": [{"documents": 1}, {"z": "}"}]}), "documents": documents, "edges": [[1, 2], {"a": "b"}]}
    with open(os.path.join(folder, name), "w") as f:
        json.dump(obj, f, ensure_ascii=name.startswith("a"), indent=indent)
    return obj


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_equals_the_plain_parser(spark, scratch, monkeypatch, size):
    ship_package(spark)
    monkeypatch.setattr(J, "RANGE_BYTES", size if size > 1 else 3)
    files = {"a.json": HARD, "b.json": HARD[::-1] * 2, "c.json": [], "d.json": [{"one": 1}]}
    if size < 64:
        files = {"a.json": HARD[:4], "c.json": []}
    for name, docs in files.items():
        _write(scratch, name, docs, indent=1 if name == "b.json" else None)
    got = {}
    df = J.read_json_array(spark, scratch, "documents")
    for r in df.collect():
        got.setdefault(os.path.basename(r.file), []).append((r.pos, json.loads(r.value)))
    assert {f: sorted(v, key=lambda x: x[0]) for f, v in got.items()} == {f: list(enumerate(d)) for f, d in files.items() if d}
    edges = J.read_json_array(spark, f"{scratch}/a.json", "edges").orderBy("pos").collect()
    assert [json.loads(r.value) for r in edges] == [[1, 2], {"a": "b"}]


def test_one_large_file_is_many_tasks(spark, scratch, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(J, "RANGE_BYTES", 20_000)
    docs = [{"relative_path": f"f{i}.rs", "body": 'x{"\\' * (i % 50)} for i in range(2000)]
    _write(scratch, "big.json", docs)
    df = J.read_json_array(spark, scratch, "documents")
    assert df.rdd.getNumPartitions() > 5
    assert [json.loads(r.value) for r in sorted(df.collect(), key=lambda r: r.pos)] == docs


def test_nothing_there(spark, scratch):
    ship_package(spark)
    _write(scratch, "a.json", [])
    assert J.read_json_array(spark, scratch, "documents").collect() == []
    assert J.read_json_array(spark, scratch, "other").collect() == []


@pytest.mark.parametrize("stretch", [1, 5, 64])
def test_a_task_holds_a_stretch_of_its_range(scratch, monkeypatch, stretch):
    """Ranges and elements of many stretches: the plain parser's elements, no read above a stretch."""
    sizes, docs = [], HARD * 3 + [{"body": ["]}" * 40, {"x": "\\" * 9}]}]
    monkeypatch.setattr(J, "STRETCH_BYTES", stretch)
    stretches = J._Bytes.__init__
    monkeypatch.setattr(J._Bytes, "__init__", lambda self, raw, *rest: (sizes.append(len(raw)), stretches(self, raw, *rest))[1])
    _write(scratch, "a.json", docs)
    path = os.path.join(scratch, "a.json")
    n = os.path.getsize(path)
    for cut in (n, 97):
        ranges = [J.Range(path, a, min(a + cut, n), n) for a in range(0, n, cut)]
        inside = depth = 0
        for r in ranges:
            r.inside, r.depth = inside, depth
            _, _, odd, plain, quoted, _ = next(J._summary(r))
            depth, inside = depth + (quoted if inside else plain), inside ^ odd
        assert (inside, depth) == (0, 0)
        opens = [e for r in ranges for e in J._events(r) if e[2] == 1 and e[5] == "documents"]
        closes = [e for r in ranges for e in J._events(r) if e[2] == 0 and e[3] > opens[0][3]]
        for r in ranges:
            r.extents = ((opens[0][3], closes[0][3]),)
        assert [json.loads(t) for r in ranges for t in J._texts(r)] == docs
    assert max(sizes) <= stretch


def test_a_dump_object_holds_one_document(spark, scratch):
    from pyspark.sql import functions as F

    from specsift.sources.dump import read_symbol_dump, write_symbol_dump

    d = spark.range(50).select(F.col("id").alias("doc_pos"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("relative_path"))
    write_symbol_dump(d, f"{scratch}/dump")
    lines = [json.loads(r.value) for r in spark.read.text(f"{scratch}/dump").collect()]
    assert [len(x["documents"]) for x in lines] == [1] * 50
    back = read_symbol_dump(spark, f"{scratch}/dump").select("doc_pos", "relative_path").collect()
    assert sorted(map(tuple, back)) == [(i, f"f{i}") for i in range(50)]
