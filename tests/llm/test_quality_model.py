"""The classifier against a plain restatement, on hard rows, and on held-out labels."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from specsift.llm import quality_model as Q

SF = "/root/testdata/sf0.01"
M = 1 << 64


def _mix(h):
    for a in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * a % M
    return h ^ (h >> 33)


def _hash(raw):
    base = 0x9E3779B97F4A7C15 | 1
    return _mix(sum((b + 1) * pow(base, i, M) for i, b in enumerate(raw)) % M)


def grams(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    whole = [_hash(x) for x in w]
    out = whole + [_mix((a * 0x9E3779B97F4A7C15 + b) % M) for a, b in zip(whole, whole[1:])]
    out += [_mix((_hash(x[-3:]) + 0xD1B54A32D192ED03) % M) for x in w]
    out += [_mix((_hash(a[-2:]) * 0x9E3779B97F4A7C15 + _hash(b[-2:]) + 0xD1B54A32D192ED03) % M) for a, b in zip(w, w[1:])]
    out += [0x9E3779B97F4A7C15 for a, b in zip(w, w[1:]) if a == b]
    return [h % Q.BUCKETS for h in out]


def _strength(sites):
    """sites: (n, rate, parent)."""
    n = sum(s[0] for s in sites)
    spread = (sum(m * (r - p) ** 2 for m, r, p in sites) - sum(p * (1 - p) for _, _, p in sites)) / n
    unit = sum(m * p * (1 - p) for m, _, p in sites) / n
    return Q.MAX_STRENGTH if spread <= 0 else min(max(unit / spread - 1, Q.MIN_STRENGTH), Q.MAX_STRENGTH)


def _logit(p):
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def brute(rows, labels):
    """rows: (id, text, host, path) with distinct ids -> {id: (p_doc, host_rate, path_rate, score)}."""
    counts = np.zeros((2, Q.BUCKETS))
    for i, text, *_ in rows:
        if labels.get(i) is not None:
            for g in grams(text):
                counts[labels[i], g] += 1
    bad_total, good_total = counts.sum(axis=1)
    least = min(bad_total, good_total)
    weight = np.log((counts[1] * least / good_total + 1) / (counts[0] * least / bad_total + 1)) if least else np.zeros(Q.BUCKETS)
    evidence = {i: (lambda g: sum(weight[g]) / len(g) if g else 0.0)(grams(t)) for i, t, *_ in rows}
    bins = defaultdict(lambda: [0, 0])
    for i, y in labels.items():
        if i in evidence and y is not None:
            x = evidence[i] * Q.FINE
            bins[max(min(int(math.floor(abs(x) + 0.5) * math.copysign(1, x)), Q.BINS // 2), -Q.BINS // 2)][1 - y] += 1
    x, good, bad = (np.array(v, dtype=float) for v in zip(*[(b, *n) for b, n in sorted(bins.items())]))
    slope, offset = Q.fit_logistic(x / Q.FINE, good, bad)
    p_doc = {i: 1 / (1 + math.exp(-(slope * min(max(e, -Q.BINS / 2 / Q.FINE), Q.BINS / 2 / Q.FINE) + offset))) for i, e in evidence.items()}
    path, host = defaultdict(list), defaultdict(list)
    for i, _, h, p in rows:
        vote = float(labels[i]) if labels.get(i) is not None else p_doc[i]
        path[h, p].append(vote)
        host[h].append(vote)
    prior = sum(map(sum, host.values())) / len(rows)
    k = _strength([(len(v), sum(v) / len(v), prior) for v in host.values()])
    host_rate = {h: (sum(v) + k * prior) / (len(v) + k) for h, v in host.items()}
    k = _strength([(len(v), sum(v) / len(v), host_rate[h]) for (h, _), v in path.items()])
    path_rate = {hp: (sum(v) + k * host_rate[hp[0]]) / (len(v) + k) for hp, v in path.items()}
    out = {}
    for i, _, h, p in rows:
        site = min(max(_logit(path_rate[h, p]) - _logit(prior), -Q.MAX_SITE), Q.MAX_SITE)
        out[i] = (p_doc[i], host_rate[h], path_rate[h, p], 1 / (1 + math.exp(-(_logit(p_doc[i]) + site))))
    return out


def _case():
    rng = np.random.default_rng(21)
    rows = []
    for i in range(160):
        good = rng.random() < (0.8 if i % 4 else 0.2)
        words = [("fine" if good else "spam") + str(int(x)) if rng.random() < 0.3 else f"w{int(x)}" for x in rng.integers(0, 30, int(rng.integers(1, 25)))]
        rows.append((i, " ".join(words), f"host{i % 4}" if i % 11 else None, f"path{i % 3}", int(good) if i % 3 else None))
    rows += [(200, None, "host1", None, None), (201, "", "lonely", "p", None), (202, "word " * 70_000 + "fine1", "host2", "path1", None)]
    return rows


def test_equals_a_plain_restatement(spark):
    rows = _case()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(None, 1), (999, 0)], "doc_id long, label int")
    want = brute([r[:4] for r in rows], {r[0]: r[4] for r in rows})
    got = {r.doc_id: r for r in Q.classify_quality(docs, labels).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.p_doc, r.host_rate, r.path_rate, r.score) == pytest.approx(want[i], abs=1e-9)
        assert r.kept == (r.score >= 0.5)


def test_words_of_like_endings_differ(spark):
    rows = [(i, " ".join(f"{'a' if i < 20 else 'b'}{j}xing" for j in range(30)), "s", "l") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in (0, 1, 2, 20, 21, 22)], "doc_id long, label int")
    got = {r.doc_id: r.p_doc for r in Q.classify_quality(docs, labels).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 40))


def test_hard_tables(spark):
    schema = "doc_id long, text string, source string, lang string, label int, host string, path string, n long, p_doc double, score double"
    rows = [(1, "good words", "s", "l", 0, "x", "y", 1, 0.5, 0.5), (1, "good words", "s", "l", 0, "x", "y", 1, 0.5, 0.5),
            (2, "bad things", None, None, 1, None, None, 2, None, None), (None, "no id", "s", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, label int")
    got = Q.classify_quality(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, 2: 1, None: 1}
    ones = [r for r in got if r.doc_id == 1]
    assert ones[0] == ones[1] and ones[0].kept
    one_class = Q.classify_quality(docs, labels.where("label = 1")).collect()
    assert len(one_class) == 4 and all(r.kept for r in one_class)
    assert Q.classify_quality(docs.limit(0), labels).collect() == []
    assert Q.classify_quality(docs.limit(0), labels.limit(0)).collect() == []


def test_held_out_labels(spark):
    """Labels of a third of the ids are not shown: nearly all good documents stay, few bad ones."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    shown = labels.where(~hidden).select("doc_id", F.col("quality").alias("label"))
    got = Q.classify_quality(docs, shown).join(labels.where(hidden), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] >= 0.95 and kept[0] <= 0.2
