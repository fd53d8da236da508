"""Scalar text functions against expected strings worked out by hand, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specsift.functions import text as T

# (text, with operators rewritten, with variables renamed too), worked out by hand
NORMALISE_CASES = [
    ("a times b", "a * b", "var1 * b"),
    ("a mul b", "a * b", "var1 * b"),
    ("a multiply b", "a * b", "var1 * b"),
    ("a div b", "a / b", "var1 / b"),
    ("a divide b", "a / b", "var1 / b"),
    ("x modulo m", "x mod m", "x mod m"),
    ("x > 0 when y = 5", "x > 0 if y = 5", "var1 > 0 if var2 = 5"),
    ("a = b iff c = d", "a = b if and only if c = d", "var1 = var2 if and only if var3 = d"),
    ("x leq y", "x <= y", "var1 <= y"),
    ("x geq y", "x >= y", "var1 >= y"),
    ("x neq y", "x != y", "x != y"),
    ("a TIMES b", "a * b", "var1 * b"),
    ("α times β", "α * β", "α * β"),
    ("", "", ""),
    ("x times y div z", "x * y / z", "var1 * var2 / z"),
    ("multiply multiplied mul", "* multiplied *", "* multiplied *"),
    ("if a times b <= c then a <= c div b", "if a * b <= c then a <= c / b", "if var1 * var2 <= var3 then var1 <= var3 / var2"),
    ("x <= z / y if x * y <= z and y > 0", "x <= z / y if x * y <= z and y > 0",
     "var1 <= var3 / var2 if var1 * var2 <= var3 and var2 > 0"),
    ("A + b when B > a", "A + b if B > a", "var1 + var2 if var2 > var1"),
    ("model of MOD", "model of MOD", "model of MOD"),
]

# (query, its variations in order), worked out by hand
VARIATION_CASES = [
    ("x % 5 = 0", ["x % 5 = 0", "x mod 5 = 0"]),
    ("x mod 5 = 0", ["x mod 5 = 0", "x % 5 = 0"]),
    ("x % 5 mod 3", ["x % 5 mod 3"]),
    ("the model", ["the model", "the %el"]),
    ("if p then q", ["if p then q", "q if p"]),
    ("If  p  THEN  q ", ["If  p  THEN  q ", "q if p"]),
    ("q if p", ["q if p", "if p then q"]),
    ("q if p and r", ["q if p and r", "if p and r then q", "q if r and p", "if r and p then q"]),
    ("q if p AND r", ["q if p AND r", "if p AND r then q", "q if r and p", "if r and p then q"]),
    ("q if p and r and s", ["q if p and r and s", "if p and r and s then q"]),
    ("q if p and p", ["q if p and p", "if p and p then q"]),
    ("s = t if and only if u", ["s = t if and only if u", "if and only if u then s = t"]),
    ("plain words", ["plain words"]),
    ("", [""]),
]


def _rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, q string")


def test_operator_rewrites_exact(spark):
    df = _rows(spark, ["x times y div z", "a TIMES b", "x > 0 when y = 5", "a = b iff c = d"])
    got = [r[0] for r in df.orderBy("id").select(T.normalize_operators("q")).collect()]
    assert got == ["x * y / z", "a * b", "x > 0 if y = 5", "a = b if and only if c = d"]


def test_variable_renaming_exact(spark):
    df = _rows(spark, ["b + a = c", "X * y", "a cat sat"])
    got = [r[0] for r in df.orderBy("id").select(T.normalize_variables("q")).collect()]
    assert got == ["var2 + var1 = c", "var1 * y", "a cat sat"]


@pytest.mark.parametrize("fn,column", [(T.normalize_operators, 1), (T.normalize_query, 2)])
def test_normalisation_by_hand(spark, fn, column):
    df = _rows(spark, [c[0] for c in NORMALISE_CASES])
    got = [r[0] for r in df.orderBy("id").select(fn("q")).collect()]
    assert got == [c[column] for c in NORMALISE_CASES]


def test_variations_by_hand(spark):
    df = _rows(spark, [c[0] for c in VARIATION_CASES])
    got = [list(r[0]) for r in df.orderBy("id").select(T.query_variations("q")).collect()]
    assert got == [c[1] for c in VARIATION_CASES]


WORDS = st.lists(st.sampled_from(["if", "then", "and", "x", "y", "mod", "%", "times", "when", ">", "0", "a", "b", "IF", "And", "5",
                                  "=", "iff", "leq", "  "]), min_size=0, max_size=9)


@settings(max_examples=15, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=12))
def test_normalisation_properties(spark, queries):
    """A second pass keeps operators; renaming depends on letters only through their order;
    variations start with the query, repeat nothing, and swapping mod and % goes both ways."""
    texts = [" ".join(w) for w in queries]
    df = _rows(spark, texts).select("id", "q", T.normalize_operators("q").alias("o"), T.normalize_query("q").alias("n"))
    shifted = F.col("o")
    for old, new in zip("xyab", "pqcd"):  # keeps the alphabetical order
        shifted = F.regexp_replace(shifted, rf"\b{old}\b", new)
    df = df.select("*", T.normalize_operators("o").alias("o2"), T.query_variations("n").alias("v"),
                   T.normalize_variables("o").alias("r1"), T.normalize_variables(shifted).alias("r2"))
    for r in df.collect():
        assert r.o2 == r.o
        if not any(w in ("b", "a", "x", "y") for w in r.r1.split()):
            assert r.r1 == r.r2
        assert r.v[0] == r.n and len(set(r.v)) == len(r.v) <= 6
        if "mod" in r.n.lower() and "%" not in r.n:
            assert r.n.replace("mod", "%") in r.v


def test_searchable_text_and_card(spark):
    df = spark.createDataFrame(
        [("lemma_a", "src/a.rs", 3, "Doc.", "fn a()", ["x > 0 ", "y"], [], "vstd")],
        "name string, file_path string, line_number int, documentation string, signature string, "
        "requires_clauses array<string>, ensures_clauses array<string>, source string")
    r = df.select(
        T.searchable_text("name", "documentation", "signature", "requires_clauses", "ensures_clauses").alias("t"),
        T.display_card("name", "file_path", "line_number", "documentation", "signature", "requires_clauses",
                       "ensures_clauses", "source").alias("c"),
        T.plain_embedding_text("name", "documentation", "signature", "requires_clauses", "ensures_clauses").alias("p"),
    ).first()
    assert r.t == "Name: lemma_a Documentation: Doc. Signature: fn a() Preconditions: x > 0  AND y"
    assert r.c.split("\n")[0] == "\U0001f4cb lemma_a (vstd)"
    assert r.c.split("\n")[1] == "   \U0001f4e6 src/a.rs:3"
    assert r.c.split("\n")[-1] == "      • y"
    assert r.p == "lemma_a Doc. fn a() x > 0  y"


def test_human_size(spark):
    cases = {0: "0.0 B", 1023: "1023.0 B", 1536: "1.5 KB", 1280: "1.2 KB", 1024 ** 2: "1.0 MB",
             5 * 1024 ** 3: "5.0 GB", 1024 ** 4: "1.0 TB", 3 * 1024 ** 5: "3072.0 TB"}
    df = spark.createDataFrame([(k,) for k in cases], "n long")
    got = {r.n: r.s for r in df.select("n", T.human_size("n").alias("s")).collect()}
    assert got == cases


def test_node_query_text(spark):
    df = spark.createDataFrame([("f", "l1\nl2\nl3\nl4\nl5\nl6"), ("g", ""), ("h", None)], "n string, b string")
    got = [r[0] for r in df.select(T.node_query_text("n", "b")).collect()]
    assert got == ["f l1 l2 l3 l4 l5", "g", "h"]


def test_permalink(spark):
    df = spark.createDataFrame([("src/x.rs", 7, "p/"), ("p/src/x.rs", 0, "p/"), ("", 3, "")],
                               "f string, l int, pre string")
    got = [r[0] for r in df.select(T.permalink(F.lit("https://h/r"), F.lit("main"), "pre", "f", "l")).collect()]
    assert got == ["https://h/r/blob/main/p/src/x.rs#L7", "https://h/r/blob/main/p/src/x.rs", None]
