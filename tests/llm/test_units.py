"""In-task helpers of the operators."""

import numpy as np

from specsift.llm.html_text import page_text
from specsift.llm.packing import hilbert_key
from specsift.llm.toxicity import Searcher, build_index, isotonic, sketch, weigh


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    key = hilbert_key(points, 3)
    assert sorted(key) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_page_layout():
    page = (
        "<html><head><title>no</title></head><body><p>One<p hidden>no<p>Two <b>bold</b><br>line"
        "<ul><li>a<li>b<ol><li>x</ol></ul><script>no()</script><div style='display:none'>no</div>"
        "<table><tr><th>k<th>value<tr><td>long key<td>v</table><pre> a\n  b</pre>"
    )
    assert page_text(page).split("\n") == [
        "One", "", "Two bold", "line", "", "- a", "- b", "  1. x", "", "k        | value", "long key | v", "", " a", "  b",
    ]


def test_broken_pages():
    assert page_text(None) is None
    assert page_text("") == ""
    assert page_text("a < b <i>c</b> </p> <unclosed") .startswith("a < b c")
    assert page_text("<div>" * 5000 + "deep") == "deep"


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    cells = [(np.sort(rng.choice(40, 6, replace=False)), rng.integers(1, 4, 6).astype(float)) for _ in range(700)]
    idf = rng.random(40) + 0.5
    weighted = [(at.astype("<i4"), weigh(idf, at, times).astype("<f4")) for at, times in cells]
    index = build_index(idf, range(700), rng.integers(0, 2, 700), np.ones(700), weighted, np.array([sketch(*w) for w in weighted]))
    dense = np.zeros((700, 40))
    for row, example in zip(dense, index.ids):
        row[weighted[example][0]] = weighted[example][1]
    queries = [(at, weigh(idf, at, times)) for at, times in cells[:40]]
    for (at, q), (found, cosines) in zip(queries, Searcher(index).nearest(queries, 15)):
        every = dense[:, at] @ q
        assert np.allclose(cosines, np.sort(every)[::-1][:15], atol=1e-6)
        assert np.allclose(every[found], cosines, atol=1e-6)


def test_isotonic_is_monotone():
    x = np.array([0.1, 0.4, 0.35, 0.8, 0.8, 0.9])
    points, values = isotonic(x, np.array([0, 1, 0, 1, 0, 1.0]), np.ones(6))
    assert (np.diff(values) >= 0).all() and (np.diff(points) >= 0).all()
