"""Tables lose no visible text, whatever tags the markup leaves out."""

import re

import numpy as np
import pytest

from specsift.llm.html_text import page_text


@pytest.mark.parametrize(
    "page, lines",
    [
        ("<table><td>A<td>B</table>", ["A | B"]),
        ("<table><tbody><td>A", ["A"]),
        ("<tbody><td>A", ["A"]),
        ("<table><tr><td>a</tr><td>b</table>", ["a", "b"]),
        ("<table><tbody><td>1<tbody><td>2<tfoot><th>3</table>", ["1", "2", "3"]),
        ("<table><div>note</div><tr><td>x</table>after", ["note", "x", "", "after"]),
        ("<table>t1<tr>t2<td>c</td>t3</tr>t4</table>", ["t1 t2 t3 t4", "c"]),
        ("<table><tbody>in body<tr><td>c</table>", ["in body", "c"]),
        ("<table><b>bold <i>it</i></b>er<td>c", ["bold iter", "c"]),
        ("<table><form><tr><td>a<td>b</form></table>", ["a | b"]),
        ("<table><caption>cap<tr><td>x<td>y<tr><td>long<td>z</table>", ["cap", "x    | y", "long | z"]),
        ("<table><td><table><td>in</table><td>out</table>", ["in | out"]),
        ("<table><p hidden>no<td hidden>no<td>yes</table>", ["yes"]),
        ("<table>a<table><td>b</table>", ["a", "", "b"]),
        ("<div><td>no table</td></div>", ["no table"]),
    ],
)
def test_table_text(page, lines):
    assert page_text(page).split("\n") == lines


@pytest.mark.parametrize("part", ["<table>", "<table><td>", "<table><tr><td>", "<table><div>", "<table><caption>", "<table><tr><td><div>"])
def test_deep_tables(part):
    assert page_text(part * 2000 + "deep").split() == ["deep"]


@pytest.mark.parametrize(
    "page, lines",
    [
        ("a<textarea>b &amp; <i>c</textarea>d", ["a b & <i>c d"]),
        ("x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> z", ["x y=2 z"]),
        ("<svg><title>no</title><defs><text>no</text></defs><text>drawn</text></svg>", ["drawn"]),
        ("<object data=x>fallback <b>text</b></object>", ["fallback text"]),
        ("<select><option>one<option selected>two<option>three</select>", ["two"]),
        ("<select><option>one<option>two</select>", ["one"]),
        ("<select multiple><option>one<option>two</select>", ["one", "two"]),
        ("<div style='visibility: hidden'>no <b style='visibility:visible'>yes</b> no</div>", ["yes"]),
        ("<div style='display:none'>no <b style='visibility:visible'>no</b></div>", [""]),
        ("<details><summary>sum</summary>no<p>no</details><details open><summary>s2</summary>yes</details>", ["sum", "s2", "yes"]),
        ("<details>no</details>after", ["after"]),
        ("<table><tr><td rowspan=2>r<td>a<tr><td>b</table>", ["r | a", "  | b"]),
        ("<table><tr><td>a<td rowspan=0>all<tr><td>b<td>c<tbody><tr><td>d<td>e</table>", ["a | all", "b |     | c", "d | e"]),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>", ["wide |   | x", "1    | 2 | 3"]),
        ("<table><tr><td colspan=900>w<td>x</table>", ["w | x"]),
        ("<table><tr><td style='visibility:hidden'>no<td>b<tr><td>c<td>d</table>", ["  | b", "c | d"]),
        ("<ol><li>a<li value=7>b<li>c</ol>", ["1. a", "7. b", "8. c"]),
    ],
)
def test_visible_text(page, lines):
    assert page_text(page).split("\n") == lines


@pytest.mark.parametrize("n", [3, 39, 41, 300])
def test_tables_of_any_depth_are_laid_out_alike(n):
    assert page_text("<table><tr><td>a<td>" * n + "x").split() == ["a", "|"] * n + ["x"]


class Pages:
    """Random pages whose texts are words of their own, with the words that must come out, in order."""

    def __init__(self, rng):
        self.rng, self.count, self.words = rng, 0, []

    def word(self, seen):
        self.count += 1
        if seen:
            self.words.append(f"w{self.count}w")
        return f" w{self.count}w "

    def node(self, depth, shown=True, seen=True):
        kind = self.rng.choice(["text", "block", "inline", "list", "hidden", "off", "on", "select", "details", "script", "comment", "table"]) if depth else "text"
        inner = lambda s=shown, v=seen: "".join(self.node(depth - 1, s, v) for _ in range(self.rng.integers(0, 4)))
        if kind == "text":
            return self.word(shown and seen)
        if kind == "block":
            tag = self.rng.choice(["div", "p", "section", "h2", "blockquote"])
            return f"<div><{tag}>{self.word(shown and seen)}</{tag}>{inner()}</div>"
        if kind == "inline":
            return f"<span>{inner()}</span>"
        if kind == "list":
            return "<ul>" + "".join(f"<li>{self.node(depth - 1, shown, seen)}" for _ in range(3)) + "</ul>"
        if kind == "hidden":
            return f"<div {self.rng.choice(['hidden', 'style=display:none'])}>{inner(False)}</div>"
        if kind == "off":
            return f"<div style='visibility: hidden'>{inner(shown, False)}</div>"
        if kind == "on":
            return f"<div style='visibility: visible'>{inner(shown, True)}</div>"
        if kind == "select":
            return f"<select><option>{self.word(shown and seen)}</option><option>{self.word(False)}</option></select>"
        if kind == "details":
            return f"<details><summary>{self.word(shown and seen)}</summary>{inner(False)}</details>"
        if kind == "script":
            return f"<script>{self.word(False)}</script>"
        if kind == "comment":
            return f"<!--{self.word(False)}-->"
        rows = "".join("<tr>" + "".join(f"<td>{self.node(depth - 1, shown, seen)}</td>" for _ in range(2)) + "</tr>" for _ in range(2))
        return f"<table>{rows}</table>"


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages_lose_and_gain_no_word(seed):
    pages = Pages(np.random.default_rng(seed))
    html = "".join(pages.node(4) for _ in range(4))
    assert re.findall(r"w\d+w", page_text(html)) == pages.words


def test_hard_rows(spark):
    from specsift.llm.html_text import extract_text

    rows = [(1, "<p>a", "x", "y"), (1, "<p>a", "x", "y"), (None, None, None, None), (2, "", "x", "y"), (3, "<div>" * 50_000 + "end", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, id string")
    assert sorted(map(str, map(tuple, extract_text(pages).collect()))) == sorted(map(str, [(1, "a"), (1, "a"), (None, None), (2, ""), (3, "end")]))
    assert extract_text(pages.limit(0)).collect() == []
