"""The five stages against a brute-force version, each on what its predecessor kept."""

import math
import struct
import zlib
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from specsift.llm.quality_rules import BUCKETS, THRESHOLD

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _hash(*parts):
    """The hash of the n-grams: of text or whole numbers, one seeding the next."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p.encode() if isinstance(p, str) else struct.pack("<i", p), seed=seed).intdigest()
    return (seed - (1 << 64) if seed >= 1 << 63 else seed) % BUCKETS


def _grams(text):
    w = brute.spaced(text)
    return [_hash(x) for x in w] + [_hash(a, b) for a, b in zip(w, w[1:])] + [_hash(x[-3:], 3) for x in w]


def quality(rows, trusted):
    grams = [_grams(r[1]) for r in rows]
    raw, target = Counter(), Counter()
    for r, g in zip(rows, grams):
        raw.update(g)
        if r[0] is not None and r[0] in trusted:
            target.update(g)
    share = sum(target.values()) / max(1, sum(raw.values()))
    odds = {b: 1000 * math.log((target[b] + 1) / (raw[b] * share + 1)) for b in raw}
    weight = {b: int(Decimal(x).quantize(Decimal(1), ROUND_HALF_UP)) if share else 0 for b, x in odds.items()}
    kept = []
    for r, g in zip(rows, grams):
        ratio = sum(weight[b] for b in g) / (1000 * len(g)) if g else 0.0
        if not brute.base_quality(r[1])[-1] and ratio >= THRESHOLD:
            kept.append(r)
    return kept


def lines(rows):
    clean = brute.dedup_lines([(r[0], r[1], r[3]) for r in rows])
    out = []
    for r in rows:
        text, _, removed = clean[r[0]]
        if removed and not text.strip(" \t\n\r\x0b\x0c"):
            continue
        out.append((r[0], text, *r[2:4], len(text) if removed else r[4]))
    return out


def near(rows):
    groups = brute.near_duplicates([(r[0], r[1]) for r in rows], k=5)
    return [r for r in rows if groups[r[0]][1] == r[0]]


def clean(rows, items):
    bad = {i for i, *_, hit in brute.contaminated([(r[0], r[1]) for r in rows], items) if hit}
    return [r for r in rows if r[0] not in bad]


def _tables(spark, folder, rows, schema=SCHEMA, labels=None, items=None):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items or [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def case(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = [r for r in rows if dict(labels).get(r[0]) == 1]
    long = good[0][1]
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "short text", "en", "s", 10)]
    rows += [(5010 + i, long.replace(long.split()[5], "changed", 1) if i else long, "en", f"s{i}", len(long)) for i in range(3)]
    rows += [(5020 + i, good[1 + i][1] + "\nthe very same footer line of all sites", "en", f"site{i}", 1) for i in range(4)]
    rows += [(5030, good[6][1] + " " + items[0][1], "en", "s", 1)]
    return rows, labels, items


def _stages(rows, labels, items):
    trusted = {d for d, q in labels if q == 1}
    steps = [quality(rows, trusted)]
    steps.append(lines(steps[-1]))
    steps.append(near(steps[-1]))
    steps.append(clean(steps[-1], items))
    return steps


def test_stages_equal_brute_force(spark, case, tmp_path):
    rows, labels, items = case
    folder = _tables(spark, tmp_path, rows, labels=labels, items=items)
    want = _stages(rows, labels, items)
    assert all(len(a) > len(b) for a, b in zip([rows, want[0], want[1], want[2]], [want[0], want[2], want[3], []]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        before = docs.columns
        docs = stage(spark, docs, folder)
        docs = corpus_pipeline.write_stage(docs, f"test-{name}")
        assert docs.columns == before
        assert sorted(map(tuple, docs.collect())) == sorted(expected), name
    last = _pieces(corpus_pipeline.STAGES[-1][1](spark, docs, folder))
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert last == {r[0]: encode.encode(r[1], add_special_tokens=False).ids + [0] for r in want[-1]} or _same(last, want[-1], encode)


def _pieces(packed):
    found = defaultdict(list)
    for r in packed.collect():
        found[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    return {d: sorted(v) for d, v in found.items()}


def _same(found, rows, encode):
    assert found.keys() == {r[0] for r in rows}
    for doc, text, *_ in rows:
        ids, at = np.array(encode.encode(text, add_special_tokens=False).ids + [0], "<u4"), 0
        for start, length, crc, total in found[doc]:
            assert (start, crc, total) == (at, zlib.crc32(ids[at : at + length].tobytes()), len(ids))
            at += length
        assert at == len(ids)
    return True


CLASHES = ("n_words kept n_symbols log_ratio base_failed n_lines n_removed key hash__x component_id n_shingles n_hit spans item_ids at id line "
           "sequence_id offset ids site place verdict").split()


def test_clashing_columns_change_nothing(spark, case, tmp_path):
    rows, labels, items = case
    plain = _pieces(corpus_pipeline.run(spark, _tables(spark, tmp_path / "a", rows, labels=labels, items=items)))
    extra = [(*r, *[f"own {c}" for c in CLASHES]) for r in rows]
    schema = SCHEMA + "".join(f", {c} string" for c in CLASHES)
    folder = _tables(spark, tmp_path / "b", extra, schema, labels, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_stage(stage(spark, docs, folder), f"clash-{name}")
        assert all(tuple(r[c] for c in CLASHES) == tuple(f"own {c}" for c in CLASHES) for r in docs.collect())
    assert {d: [p[3] for p in v][:1] for d, v in _pieces(corpus_pipeline.STAGES[-1][1](spark, docs, folder)).items()} == {
        d: [p[3] for p in v][:1] for d, v in plain.items()}


def test_nulls_repeats_and_empty_tables(spark, case, tmp_path):
    rows, labels, items = case
    again = [r for r in rows if r[0] is not None][:30] * 2 + [(None, rows[3][1], "en", "s", 1)] * 2
    got = _pieces(corpus_pipeline.run(spark, _tables(spark, tmp_path / "a", again, labels=labels, items=items)))
    assert got.keys() <= {r[0] for r in again}
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path / "b", [])).collect() == []
