"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: the mean log odds of its hashed n-grams (whole words,
neighbouring words, the endings of both, and repeated words) between documents labelled good and bad (two multinomials over all labelled
rows), turned into a probability by a logistic curve fitted on a histogram of
the labelled rows' evidence.

Sites: every document counts for its host and its path with its label, or its
probability where it has none.  Host rates shrink towards the global rate and
path rates towards their host's, by prior strengths estimated from the spread
of the rates (method of moments), so sparse sites fall back to their parents.
A document's score combines its own odds with its path's shrunk odds relative
to the global odds.

Hosts and paths are columns (``source`` and ``lang`` of the documents; for
pages, parts of the URL).  Everything but the model tables (2**16 weights,
BINS histogram cells) stays distributed.

Defined results: null and empty texts have no evidence (log odds 0) and rest
on their site; a null host or path is a site of its own; without labels of
both classes every score is the global prior and all documents are kept; labels
of repeated ids count once (1 if any is), null ids and labels never; repeated
rows are judged one by one alike; a score equal to the threshold is kept; long
texts count whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .words import SPACED, Words, _powers, mix, split_words

BUCKETS = 1 << 16
#: Cells of the histogram, and cells per unit of evidence.
BINS, FINE = 2000, 200
#: Bounds of a prior's strength in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
#: What a site's odds may add to a document's, in natural log units.
MAX_SITE = 2.0

_U = np.uint64
#: Keep the kinds of n-grams apart.
_PAIR, _ENDING = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of whole words, of neighbouring words, of word endings (up
    to 3 bytes), of neighbours' endings (up to 2 bytes), and of a word that
    repeats the one before (whichever it is)."""
    n = len(words.data)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((words.data.astype(np.uint64) + _U(1)) * power[:n], out=sums[1:])
    doc = words.doc_of()
    run = lambda at: mix((sums[words.ends] - sums[at]) * inverse[at])
    whole = run(words.starts)
    three, two = (run(np.maximum(words.ends - k, words.starts)) for k in (3, 2))
    same = doc[1:] == doc[:-1]
    pair = mix(whole[:-1] * _PAIR + whole[1:])[same]
    ends = mix(two[:-1] * _PAIR + two[1:] + _ENDING)[same]
    again = doc[1:][same & (whole[1:] == whole[:-1])]
    bucket = np.concatenate([whole, pair, mix(three + _ENDING), ends, np.full(len(again), _PAIR)]) & _U(BUCKETS - 1)
    return bucket.astype(np.int64), np.concatenate([doc, doc[1:][same], doc, doc[1:][same], again])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for words in split_words(batch.column("text"), SPACED, lower=False):
            bucket, doc = _buckets(words)
            y = label[words.rows.start + doc].astype(np.int64)
            counts += np.bincount(y * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
    at = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "bad", "good"])


def _evidence(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for words in split_words(batch.column("text"), SPACED, lower=False):
                bucket, doc = _buckets(words)
                n = np.bincount(doc, minlength=len(words.rows))
                total = np.bincount(doc, weights=w[bucket], minlength=len(words.rows))
                part = batch.slice(words.rows.start, len(words.rows))
                columns = [part.column(c) for c in ("doc_id", "host", "path")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total / np.maximum(n, 1))], names=["doc_id", "host", "path", "evidence"])

    return run


def fit_logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of P(good) by Newton steps on binned counts, with a
    weak pull to slope 1."""
    a, b = 1.0, 0.0
    n = good + bad
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([((good - n * p) * x).sum() - 0.1 * (a - 1), (good - n * p).sum() - 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def _strength(rates: DataFrame, rate: Column, parent: Column) -> float:
    """Documents that a prior is worth: the rates' spread beyond binomial noise
    (method of moments, over sites weighted by size)."""
    r = rates.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (rate - parent) ** 2).alias("between"),
        F.sum(parent * (1 - parent)).alias("noise"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("unit"),
    ).first()
    if not r["n"]:
        return MAX_STRENGTH
    spread = (r["between"] - r["noise"]) / r["n"]
    unit = r["unit"] / r["n"]
    return MAX_STRENGTH if spread <= 0 else float(min(max(unit / spread - 1, MIN_STRENGTH), MAX_STRENGTH))


def classify_quality(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """(doc_id, p_doc, host_rate, path_rate, score, kept) per row of ``docs``.

    ``labelled`` has the id column and label (1 good, 0 bad).
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        (F.col("source") if host is None else host).cast("string").alias("host"),
        (F.col("lang") if path is None else path).cast("string").alias("path"),
    )
    labels = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    labels = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    labels = labels.hint("merge")  # sort-merge at any size: the labels grow with the corpus

    counts = np.zeros((2, BUCKETS))
    taught = source.select("doc_id", "text").join(labels, "doc_id")
    summed = taught.select("text", "label").mapInArrow(_class_counts, "bucket long, bad long, good long")
    for r in summed.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
        counts[:, r["bucket"]] = r["bad"], r["good"]
    weights = np.zeros(BUCKETS)
    if (counts.sum(axis=1) > 0).all():
        total = counts.sum(axis=1, keepdims=True)
        even = np.log(counts * (total.min() / total) + 1)  # an n-gram that neither class has weighs nothing
        weights = even[1] - even[0]

    seen = source.mapInArrow(_evidence(spark.sparkContext.broadcast(weights)), "doc_id long, host string, path string, evidence double")
    seen = write_stage(seen.join(labels, "doc_id", "left"), "quality-evidence")
    bins = seen.filter("label is not null").select(
        F.least(F.greatest(F.round(F.col("evidence") * FINE).cast("int"), F.lit(-BINS // 2)), F.lit(BINS // 2)).alias("bin"), "label"
    )
    table = bins.groupBy("bin").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()
    x, good, bad = (np.array([float(r[c]) for r in table]) for c in ("bin", "good", "bad"))
    slope, offset = fit_logistic(x / FINE, good, bad) if good.sum() and bad.sum() else (0.0, 30.0)
    bin_of = F.least(F.greatest(F.col("evidence"), F.lit(-BINS / 2 / FINE)), F.lit(BINS / 2 / FINE))
    p_doc = 1 / (1 + F.exp(-(slope * bin_of + offset)))
    seen = seen.withColumn("p_doc", p_doc).withColumn("vote", F.coalesce(F.col("label").cast("double"), p_doc))

    # sums by path first, so that a hot host is added up in parts
    paths = write_stage(seen.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("vote").alias("votes")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"))
    whole = hosts.agg(F.sum("votes").alias("votes"), F.sum("n").alias("n")).first()
    prior = whole["votes"] / whole["n"] if whole["n"] else 0.5
    k_host = _strength(hosts, F.col("votes") / F.col("n"), F.lit(prior))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("votes") + k_host * prior) / (F.col("n") + k_host)).alias("host_rate"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    k_path = _strength(both, F.col("votes") / F.col("n"), F.col("host_rate"))
    rates = both.select(
        "h", F.col("path").alias("p"), "host_rate",
        ((F.col("votes") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"),
    )
    out = seen.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    site = F.least(F.greatest(_logit(F.col("path_rate")) - _logit(F.lit(prior)), F.lit(-MAX_SITE)), F.lit(MAX_SITE))
    score = 1 / (1 + F.exp(-(_logit(F.col("p_doc")) + site)))
    return out.select("doc_id", "p_doc", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("kept"))
