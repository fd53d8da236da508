"""Extraction: results worked out by hand, and properties of whole files."""

from hypothesis import given, settings
from hypothesis import strategies as st

from specsift.functions.extract import declarations

# a declaration's text and its clauses, worked out by hand
PARTS = {
    "plain": ("pub proof fn plain(x: int)\n    requires x > 0, y < 2,\n    ensures x * y >= 1,\n{\n}\n", ["x > 0", "y < 2"], ["x * y >= 1"]),
    "calls": ("fn calls(a: int)\n  ensures f(a, b) == 1\n{ body(); }\n", [], ["f(a", "b) == 1"]),
    "other": ("proof fn other()\n  requires  z \n  decreases a, b\n{ }\n", ["z"], []),
    "late": ("pub fn late()\n  ensures p,\n  requires q,\n{ }\n", ["q"], ["p", "requires q"]),
    "recommended": ("fn recommended()\n  requires a\n  recommends b\n  ensures c\n{\n\n}\n", ["a"], ["c"]),
    "none": ("pub  proof\nfn none(x: int) -> bool\n{ true }\n", [], []),
}
BODYLESS = "fn bare(x: int)\n  requires own;\n"


def _got(spark, content):
    src = spark.createDataFrame([("f.rs", content)], "file_path string, content string")
    return {r.name: (list(r.requires), list(r.ensures), r.line_number) for r in declarations(src).collect()}


@settings(max_examples=12, deadline=None)
@given(st.permutations(sorted(PARTS)), st.integers(0, 4), st.sampled_from(["", "// header\n", "use a::b;\n\n"]))
def test_any_order_gives_each_its_own_clauses(spark, names, used, preamble):
    names = names[used:]
    want, line = {}, 1 + preamble.count("\n")
    for n in names:
        want[n] = (*PARTS[n][1:], line)
        line += PARTS[n][0].count("\n")
    assert _got(spark, preamble + "".join(PARTS[n][0] for n in names)) == want


def test_a_header_without_a_body_ends_at_the_next_brace(spark):
    """It takes the text up to the next declaration's brace, as the semantics ledger says."""
    got = _got(spark, BODYLESS + PARTS["plain"][0])
    assert got["bare"][1] == ["x * y >= 1"] and got["bare"][2] == 1
    assert got["plain"] == (["x > 0", "y < 2"], ["x * y >= 1"], 3)


def test_the_first_of_equal_names_wins(spark):
    first = PARTS["calls"][0]
    assert _got(spark, first + first.replace("f(a, b) == 1", "never"))["calls"] == ([], ["f(a", "b) == 1"], 1)


def test_no_brace_gives_the_line_alone(spark):
    assert _got(spark, "// x\n" + BODYLESS) == {"bare": ([], [], 2)}


def test_chunks_do_not_change_the_result(spark, monkeypatch):
    """Cuts of a few characters: the same declarations, lines and headers across chunks, and no
    row with more than its part of a file."""
    from specsift.functions import extract

    body = "".join(PARTS[n][0] for n in sorted(PARTS)) + BODYLESS + "fn two(\n)\n ensures e2;\n" + PARTS["plain"][0].replace("plain", "last") + BODYLESS
    rows = [(f"f{i}.rs", body.replace("fn ", "fn f%d_" % i) * 1) for i in range(3)] + [("empty.rs", ""), ("null.rs", None), ("none.rs", "no code")]
    src = spark.createDataFrame(rows, "file_path string, content string")
    whole = sorted(map(str, extract.declarations(src).collect()))
    assert len(whole) == 3 * (len(PARTS) + 3)
    for size in (1, 7, 40):
        monkeypatch.setattr(extract, "CHUNK_CHARS", size)
        assert sorted(map(str, extract.declarations(src).collect())) == whole
        parts = extract.source_chunks(src).orderBy("file_path", "chunk_no").collect()
        texts = {}
        for r in parts:
            texts[r.file_path] = texts.get(r.file_path, "") + r.chunk
        assert texts == {f: t for f, t in rows if t}
    assert len(parts) > 20


def test_a_file_without_braces_is_not_quadratic(spark):
    """Many headers and no brace: no header text, so nothing is gathered."""
    n = 3000
    got = _got(spark, "".join(f"fn f{i}(x)\n" for i in range(n)))
    assert len(got) == n and got["f2999"] == ([], [], 3000)
