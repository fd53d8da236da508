"""Spec fill, coverage, duplicates and pattern categories on inline rows."""

import pytest
from pyspark.sql import functions as F

from specsift.operators import neighbours
from specsift.operators.duplicates import PATTERNS, categorize_pair, exact_duplicates, pattern_counts, similar_pairs, subsumed_pairs
from specsift.operators.specs import fill_impact, fill_missing_specs, spec_coverage

SCHEMA = ("entry_pos long, name string, documentation string, requires_clauses array<string>, "
          "ensures_clauses array<string>, source string")


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_fill_prefers_last_with_specs(spark):
    ref = _df(spark, [(1, "a", "", [], []), (2, "a", "ref doc", ["p"], ["q"]), (3, "a", "", ["r"], []),
                      (4, "b", "", [], []), (5, "c", "c doc", [], ["z"])]
              and [(1, "a", "", [], [], "reflib"), (2, "a", "ref doc", ["p"], ["q"], "reflib"),
                   (3, "a", "", ["r"], [], "reflib"), (4, "b", "", [], [], "reflib"),
                   (5, "c", "c doc", [], ["z"], "reflib")])
    tgt = _df(spark, [(10, "a", "", [], [], "project"), (11, "b", "", [], [], "project"),
                      (12, "c", "own", [], [], "project"), (13, "c", "", ["k"], [], "project")])
    out = {r.entry_pos: r for r in fill_missing_specs(tgt, ref).collect()}
    assert (list(out[10].requires_clauses), list(out[10].ensures_clauses), out[10].documentation, out[10].filled) == (
        ["r"], [], "", True)
    assert out[11].filled is False
    assert (list(out[12].ensures_clauses), out[12].documentation) == (["z"], "own")
    assert out[13].filled is False
    imp = fill_impact(fill_missing_specs(tgt, ref)).first()
    assert (imp.missing_before, imp.missing_after, imp.filled) == (3, 1, 2)


def test_coverage_total_only_with_several_groups(spark):
    one = _df(spark, [(1, "a", "", ["x"], [], "p"), (2, "b", "", [], [], "p")])
    assert [(r.index_name, r.total, r.with_specs) for r in spec_coverage(one).collect()] == [("p", 2, 1)]
    two = _df(spark, [(1, "a", "", ["x"], [], "p"), (2, "b", "", [], [], "q")])
    got = sorted((r.index_name, r.total, r.with_specs) for r in spec_coverage(two).collect())
    assert got == [("TOTAL", 2, 1), ("p", 1, 1), ("q", 1, 0)]


def test_exact_and_subsumed(spark):
    e = _df(spark, [(1, "a", "", ["x > 0"], ["r"], "p"), (2, "b", "", [" x > 0"], ["r"], "p"),
                    (3, "c", "", ["x > 0", "y > 0"], ["r"], "p"), (4, "d", "", [], ["r"], "p"),
                    (5, "e", "", [], [], "p"), (6, "f", "", [], [], "p"),
                    (7, "g", "", ["y > 0", "x > 0"], ["r", "r"], "p")])
    ex = sorted((r.pos1, r.pos2) for r in exact_duplicates(e).collect())
    assert ex == [(1, 2), (3, 7)]  # empty-spec entries never pair
    sub = sorted((r.pos1, r.pos2) for r in subsumed_pairs(e).collect())
    assert sub == [(1, 3), (4, 1), (4, 3)]


def test_similar_leaves_out_members_of_structural_classes(spark):
    e = _df(spark, [(1, "a", "", ["x"], ["r"], "p"), (2, "b", "", ["x"], ["r"], "p"), (3, "c", "", [" x"], ["r"], "p"),
                    (4, "d", "", ["x", "y"], ["r"], "p"), (5, "e", "", [], [], "p"), (6, "f", "", [], [], "p"),
                    (7, "g", "", ["z"], ["r"], "p")])
    nb = spark.createDataFrame([(a, b, 0.95) for a in range(1, 8) for b in range(1, 8) if a != b],
                               "pos1 long, pos2 long, score double")
    got = {(r.pos1, r.pos2) for r in similar_pairs(nb, e, 0.9).collect()}
    structural = {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert got == {(a, b) for a in range(1, 8) for b in range(a + 1, 8)} - structural


def _nearest_brute(rows, k, at_least=-1.0, digits=12):
    """rows: (pos, vector) -> sorted (pos1, rank, pos2, score)."""
    import numpy as np

    out = []
    v = {p: np.asarray(x, dtype=float) for p, x in rows if x is not None and np.any(np.asarray(x, dtype=float))}
    for a in v:
        found = []
        for b in v:
            s = float((v[a] * v[b]).sum() / np.sqrt((v[a] * v[a]).sum() * (v[b] * v[b]).sum()))
            if a != b and s >= at_least:
                found.append((-round(s, digits), b))
        out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("at_least", [-1.0, 0.6])
def test_nearest_equals_brute_force(spark, monkeypatch, at_least):
    """Clusters, many copies of one vector, parallel vectors, zero and null vectors, many blocks."""
    import numpy as np

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "TILE", 8)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 8)) * 3
    rows = [(i, np.rint(centres[i % 9] * 4 + rng.normal(size=8) * 3).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(300, [2 * x for x in rows[3][1]]), (301, [0.0] * 8), (302, None), (303, [])]
    df = spark.createDataFrame(rows, "entry_pos long, v array<double>")
    got = sorted((r.pos1, r["rank"], r.pos2, round(r.score, 12)) for r in neighbours.nearest(df, 3, "v", at_least=at_least).collect())
    assert got == _nearest_brute([r for r in rows if r[1] != []], 3, at_least)


def test_nearest_of_hashed_ids(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    ids = {i: [int(x) for x in rng.choice([1, -2, 3, 4, 5], int(rng.integers(0, 6)))] for i in range(70)}
    df = spark.createDataFrame(sorted(ids.items()), "entry_pos long, ids array<int>")
    dense = [(p, [sum((x > 0) - (x < 0) for x in v if abs(x) == d + 1) for d in range(6)]) for p, v in ids.items()]
    got = sorted((r.pos1, r["rank"], r.pos2, r.score) for r in neighbours.nearest(df, 4, "ids", kind="ids", dims=6).collect())
    assert got == _nearest_brute(dense, 4, digits=30)  # whole counts: bit for bit


def test_bounds_prune_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 5
    df = spark.createDataFrame([(i, (centres[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(600)], "entry_pos long, v array<double>")
    assert neighbours.pruned_share(df, 5) > 0.5 and neighbours.pruned_share(df, 5, at_least=0.99) > 0.7
    assert neighbours.nearest(df.limit(0), 5).collect() == []


def test_pattern_categories(spark):
    rows = [("similar", "lemma_limb_a", "lemma_limb_b"), ("similar", "lemma_x_012", "lemma_y"),
            ("similar", "lemma_left", "lemma_q"), ("similar", "mul_le_a", "mul_lt_b"), ("similar", "p", "q"),
            ("similar", "lemma_a", "l_b"), ("exact", "limb", "limb")]
    df = spark.createDataFrame(rows, "type string, lemma1 string, lemma2 string")
    got = [r[0] for r in df.select(categorize_pair()).collect()]
    assert got[:5] == list(PATTERNS)
    assert got[5] == "other"  # "lemma_al_b" has no '_l_' marker
    counts = {r.pattern: r.n for r in pattern_counts(df).collect()}
    assert counts == {"limb_variants": 1, "incremental_lemmas": 1, "symmetric_variants": 1,
                      "comparison_variants": 1, "other": 2}


def test_fill_specs_job(spark):
    from specsift.plans.maintenance import fill_specs_job

    ref = _df(spark, [(1, "a", "d", ["p"], [], "reflib")])
    tgt = _df(spark, [(5, "a", "", [], [], "project"), (6, "b", "", [], [], "project")]).withColumn(
        "signature", F.lit("fn x()"))
    r = fill_specs_job(tgt, ref)
    assert r.impact.first().filled == 1 and r.vectors is not None and r.vectors.count() == 2
    none = fill_specs_job(tgt.where("name = 'b'"), ref)
    assert none.vectors is None


def test_hot_class_stays_linear(spark):
    """One clause class holding a third of all rows: exact duplicates are
    reported as (representative, member) rows, never all pairs."""
    rows = [(i, f"n{i}", "", ["x > 0"] if i % 3 == 0 else [f"x > {i}"], ["r"], "p") for i in range(3000)]
    e = _df(spark, rows)
    ex = exact_duplicates(e)
    assert ex.count() == 999  # 1000 members of the hot class -> 999 rows
    assert ex.where("pos1 <> 0").count() == 0
    sub = subsumed_pairs(e)
    assert sub.count() == 0  # single-clause requires never strictly contain each other


def test_fill_with_hot_name_keeps_row_count(spark):
    """A third of all rows share one name: the reference side collapses to
    one row per name first, so the fill join cannot multiply rows."""
    ref = _df(spark, [(i, "hot" if i % 3 == 0 else f"r{i}", "", ["p"] if i % 2 else [], [], "reflib")
                      for i in range(600)])
    tgt = _df(spark, [(1000 + i, "hot" if i % 3 == 0 else f"t{i}", "", [], [], "project") for i in range(900)])
    out = fill_missing_specs(tgt, ref)
    assert out.count() == 900
    assert out.where("filled").count() == 300


def _links_brute(rows, vectors, threshold, dims):
    """rows: (pos, requires, ensures) -> ({(type, c1, c2): (links, best)}, {pos: (class, exact, subsumes, subsumed)})."""
    import numpy as np

    key = {p: (frozenset(map(str.strip, r)), frozenset(map(str.strip, e))) for p, r, e in rows if r or e}
    first = {}
    for p in sorted(key):
        first.setdefault(key[p], p)
    dense = {}
    for p, ids in vectors.items():
        dense[p] = np.zeros(dims)
        for i in ids:
            dense[p][abs(i) - 1] += np.sign(i)
    links, own = {}, {p: [first[key[p]], 0, 0, 0] for p in key}
    for a in key:
        for b in key:
            (ra, ea), (rb, eb) = key[a], key[b]
            kind = "exact" if key[a] == key[b] and a < b else "subsumes" if ea and ea == eb and ra < rb else None
            na, nb = dense[a] @ dense[a], dense[b] @ dense[b]
            if kind is None or na == 0 or nb == 0 or (s := dense[a] @ dense[b] / np.sqrt(na * nb)) < threshold:
                continue
            k = (kind, first[key[a]], first[key[b]])
            n, best = links.get(k, (0, -1))
            links[k] = (n + 1, max(best, s))
            own[a][1 if kind == "exact" else 2] += 1
            own[b][1 if kind == "exact" else 3] += 1
    return links, {p: tuple(v) for p, v in own.items()}


def _links_case(spark, rows, vectors, dims=8):
    from specsift.operators.links import structural_links

    e = _df(spark, [(p, f"n{p}", "", r, c, "p") for p, r, c in rows])
    v = spark.createDataFrame(sorted(vectors.items()), "entry_pos long, ids array<int>")
    pairs, members = structural_links(e, v, 0.75, dims)
    got = {(r.type, r.pos1, r.pos2): (r.n_links, r.similarity) for r in pairs.collect()}
    own = {r.entry_pos: tuple(r)[1:] for r in members.collect()}
    want, want_own = _links_brute(rows, vectors, 0.75, dims)
    assert got.keys() == want.keys() and own == want_own
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    return got


def test_links_of_all_members_equal_brute_force(spark, monkeypatch):
    """The threshold holds for every pair of members, whatever the class's first entry; classes of
    many blocks, copies, and vectors of zero length."""
    import numpy as np

    from specsift.operators import links

    monkeypatch.setattr(links, "BLOCK_VARIANTS", 4)
    rng = np.random.default_rng(12)
    clauses = ["x > 0", "y > 0", " x > 0", "z < 1"]
    rows = [(i, [str(c) for c in rng.choice(clauses, int(rng.integers(0, 4)))], ["r"] if i % 5 else ["s", "r"]) for i in range(90)]
    rows += [(100 + i, ["hot"], ["h"]) for i in range(45)] + [(200, [], []), (201, [], ["h"]), (202, ["hot", "q"], ["h"]), (203, ["a"], [])]
    vectors = {p: [int(x) for x in rng.choice([1, 2, 3, -4], int(rng.integers(0, 6)))] for p, _, _ in rows}
    assert sum(n for n, _ in _links_case(spark, rows, vectors).values()) > 300


def test_links_of_one_class_of_copies(spark):
    got = _links_case(spark, [(i, ["x"], ["r"]) for i in range(40)], {i: [1, 2] for i in range(40)})
    assert got == {("exact", 0, 0): (40 * 39 // 2, 1.0)}


def test_links_of_nothing(spark):
    assert _links_case(spark, [], {}) == {} and _links_case(spark, [(1, [], [])], {1: [1]}) == {}


def test_containment_of_large_clause_sets(spark):
    """Classes of 11 and 40 clauses, an empty clause, and none: one path for every size."""
    big, mid = [f"c{i}" for i in range(40)], [f"c{i}" for i in range(0, 22, 2)]
    rows = [(1, big, ["r"]), (2, mid, ["r"]), (3, ["c4", "c2"], ["r"]), (4, [], ["r"]), (5, ["", "c2"], ["r"]), (6, [""], ["r"]),
            (7, ["c41"], ["r"]), (8, mid, ["other"]), (9, ["c0"], [])]
    got = {(r.pos1, r.pos2) for r in subsumed_pairs(_df(spark, [(p, "n", "", r, e, "p") for p, r, e in rows])).collect()}
    sets = {p: (set(r), set(e)) for p, r, e in rows}
    assert got == {(a, b) for a in sets for b in sets if sets[a][1] and sets[a][1] == sets[b][1] and sets[a][0] < sets[b][0]}


def test_report_is_types_patterns_and_examples(spark):
    from specsift.plans.audit import duplicate_report

    rows = [("exact", 1, 1, "a", "a", 1.0, 6), ("subsumes", 1, 9, "a", "b", 0.8, 2), ("subsumes", 2, 9, "a", "b", 0.8, 1)]
    rows += [("similar", i, i + 1, "limb_p", "limb_q", 0.95, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "type string, pos1 long, pos2 long, lemma1 string, lemma2 string, similarity double, n_links long")
    got = sorted((r.section, r.key, r.n, r.example_no, r.pos1, r.more) for r in duplicate_report(df, 2).collect())
    assert [g for g in got if g[0] == "examples"] == [("examples", "limb_variants", None, i + 1, i, 3) for i in range(2)]
    assert {g[1]: g[2] for g in got if g[0] == "types"} == {"exact": 6, "subsumes": 3, "similar": 5}
    assert {g[1]: g[2] for g in got if g[0] == "patterns"}["limb_variants"] == 5


def test_a_visitor_is_sent_once_to_a_host(spark, monkeypatch):
    """All blocks in reach: a row goes once to each host with a list of its blocks, and the result stays exact."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=12).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "entry_pos long, v array<double>")
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    one, _ = neighbours.variants(df.withColumnRenamed("v", "vector"), 3, "vector", "dense")
    blocks = neighbours.cut_into_blocks(one, 12, "dense")
    asked = blocks.rows.selectExpr("block", "variant", "vector", "-1.0D AS bar")
    sent = asked.mapInArrow(neighbours._visits(blocks, 8, 12, "dense", -1.0),
                            "variant long, vector array<double>, bar double, host long, wanted array<int>").collect()
    hosts = -(-len(blocks.number) // 8)
    assert len(blocks.number) > 16 and len(sent) <= 300 * hosts
    assert len({(r.variant, r.host) for r in sent}) == len(sent)
    assert sum(len(r.wanted) for r in sent) == 300 * (len(blocks.number) - 1)
    for size in (1, 16 * 12 * 16 * 3, 1 << 25):
        monkeypatch.setattr(neighbours, "HOST_BYTES", size)
        got = sorted((r.pos1, r["rank"], r.pos2, round(r.score, 12)) for r in neighbours.nearest(df, 3, "v").collect())
        assert got == _nearest_brute(rows, 3)
