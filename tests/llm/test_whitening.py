"""Whitening against a direct eigendecomposition of the exact covariance."""

import math

import numpy as np
import pytest

from specsift.llm.whitening import fit_whitening, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n int, x int, component string"


def brute(rows, scale=256):
    """rows: (id, vector) -> (n, {(id): deviation}, eigenvalues, eigenvectors, mean, whole vectors)."""
    good = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    dims = max((len(v) for _, v in good), default=0)
    ints = [(i, tuple(math.floor(scale * float(np.float32(e))) for e in v)) for i, v in good if len(v) == dims]
    fit = sorted({x for _, x in ints})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    if not n:
        return 0, [], np.zeros(0), None, None, []
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in ints]
    return n, deviation, e[::-1], v[:, ::-1], np.array(sums) / n, ints


def compare(spark, rows, table=None, many=4):
    df = table if table is not None else spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], SCHEMA)
    got = whiten(df, fit_whitening(df)).collect()
    n, deviation, e, v, mean, ints = brute(rows)
    # rank by singular values: eigenvalues of the covariance hold rounding noise above 1e-20 of the largest
    s = np.linalg.svd(np.array([x for _, x in ints]) - mean, compute_uv=False) if n else np.zeros(0)
    kept = min(many, int((s > 1e-10 * s.max()).sum())) if len(e) and e[0] > 1e-12 else 0
    assert len(got) == kept * len(ints)
    if not kept:
        return got
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, kept + 1))
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.deviation) for r in got) == sorted(
        (i is not None, i or 0, d) for i, d in deviation for _ in range(kept)
    )
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error < 1e-8
    return got


def signed(got, rows, k, kept):
    """Whitened values of component k (distinct eigenvalues) equal the direct ones, up to a sign."""
    n, _, e, v, mean, ints = brute(rows)
    direct = {i: (np.array(x) - mean) @ v[:, k - 1] / math.sqrt(e[k - 1]) for i, x in ints}
    own = {r.vec_id: r.whitened for r in got if r.component == k}
    sign = np.sign(sum(own[i] * direct[i] for i in own))
    assert max(abs(own[i] - sign * direct[i]) for i in own) < 1e-7


def test_query_equals_direct_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = compare(spark, rows, table)
    for k in range(1, 5):
        signed(got, rows, k, 4)


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1] + 1000]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0] * 5), (103, [None] * 6), (104, [float("nan")] * 6), (105, [float("inf")] + [0.0] * 5)]
    rows += [(200 + i, rows[0][1]) for i in range(300)] + [rows[1], rows[1], (None, rows[2][1])]
    compare(spark, rows)


def test_ties_and_ranks(spark):
    square = [(i, [float(a), float(b), 0.0, 0.0, 7.0]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    compare(spark, square)  # two equal deviations, the others none
    cube = [(i, [1.0 if (i >> b) & 1 else -1.0 for b in range(5)]) for i in range(32)]
    compare(spark, cube)  # five equal deviations
    compare(spark, [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(9)])  # rank one
    compare(spark, [(1, [0.5, 0.25])] * 5)  # no spread
    compare(spark, [(1, [3.0]), (2, [4.0])])


def test_empty_and_overflow(spark):
    assert compare(spark, []) == []
    assert compare(spark, [(1, None)]) == []
    far = spark.createDataFrame([(i, [2.0**50 * i, 1.0 * i]) for i in range(1, 4)], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whiten(far, fit_whitening(far)).collect()} == {(1, None), (2, 0), (3, None)}
