"""License scan by ordered signature rules.

A text's lower-cased words, joined by single spaces, are searched with the
rules of ``license_rules`` of which a gate occurs in it: a literal that every
match of one of the rule's alternatives has.  Overlapping detections
are resolved in order: higher priority first, then longer, then earlier; a
detection that lies within an accepted one is suppressed.  Texts
without any gate (nearly all) are only counted.

Three base phrases are reported apart, wherever their words stand
consecutively, and never suppressed.

Defined results: a null text counts as empty, with no words and labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import KINDS, gates, rules
from .words import ALNUM, Words, split_words

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_compiled: tuple | None = None


def _rules():
    """(shortest gates, all gates, [(gates, label, priority, confidence, regex)]); once per worker."""
    global _compiled
    if _compiled is None:
        entries = []
        for label, kind, _, pattern in rules():
            priority, confidence = KINDS[kind]
            entries.append((gates(pattern), label, priority, confidence, re.compile(f"(?<= )(?:{pattern})(?= )")))
        every = sorted({g for known, *_ in entries for g in known} | set(BASE_PHRASES))
        # a text with a gate has every gate inside it
        short = [g.encode() for g in every if not any(x != g and x in g for x in every)]
        _compiled = (short, every, entries)
    return _compiled


def _joined(words: Words) -> tuple[bytes, np.ndarray]:
    """The slice's words, each followed by a space or at the end of a text by
    a line feed, and the place of every text."""
    size = words.ends - words.starts
    out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = words.data[ALNUM[words.data]]
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    bounds = ends[words.first]
    out[bounds[1:][np.diff(bounds) > 0] - 1] = 10
    return out.tobytes(), bounds


def _gated(words: Words) -> set[int]:
    """Texts with any gate among their words."""
    text, bounds = _joined(words)
    hot = set()
    for gate in _rules()[0]:
        at = text.find(gate)
        while at >= 0:
            d = int(np.searchsorted(bounds, at, side="right")) - 1
            hot.add(d)
            at = text.find(gate, int(bounds[d + 1]))
    return hot


def detect(padded: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) in characters of a padded word string,
    after suppression, by place."""
    found = []
    _, every, entries = _rules()
    there = {g for g in every if g in padded}
    for known, label, priority, confidence, regex in entries:
        if not there.isdisjoint(known):
            found += [(-priority, m.start() - m.end(), m.start(), m.end(), label, confidence) for m in regex.finditer(padded)]
    found.sort()
    kept: list[tuple[int, int, str, float]] = []
    for _, _, start, end, label, confidence in found:
        if not any(a <= start and end <= b for a, b, _, _ in kept):
            kept.append((start, end, label, confidence))
    return sorted(kept)


def _document(words: Words, d: int) -> tuple[int, int | None, int | None, str, str, float, list]:
    lo, hi = int(words.first[d]), int(words.first[d + 1])
    starts, ends = words.starts[lo:hi], words.ends[lo:hi]
    raw = words.data
    # the words with single spaces: offsets follow from the word lengths
    text = " " + " ".join(raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())) + " "
    places = [(m.start(), label) for phrase, label in BASE_PHRASES.items() for m in re.finditer(f"(?= {phrase} )", text)]
    spans = detect(text)
    if not places and not spans:
        return 0, None, None, "", "", 0.0, []
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 32)
    word_at = lambda c: int(np.searchsorted(spaces, c, side="right")) - 1
    at = [word_at(c) for c, _ in places]
    base = {label for _, label in places}
    labels = base | {label for _, _, label, _ in spans}
    miss = float(np.prod([1 - c for _, _, _, c in spans])) if spans else 1.0
    score = max(1 - miss, 0.9 if base else 0.0)
    listed = [{"start": word_at(a - 1), "end": word_at(b), "label": label, "confidence": c} for a, b, label, c in spans]
    return len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(score, 1.0), listed


_FIELDS = [
    ("n_base", pa.int64()),
    ("first_word", pa.int64()),
    ("last_word", pa.int64()),
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))),
]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = (0, None, None, "", "", 0.0, [])
    for batch in batches:
        for words in split_words(batch.column("text"), ALNUM):
            hot = _gated(words)
            found = [_document(words, d) if d in hot else nothing for d in range(len(words.rows))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(words.rows.start, len(words.rows)),
                    pa.array(words.counts.astype(np.int64)),
                    *[pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(_FIELDS)],
                ],
                names=["doc_id", "n_words", *[name for name, _ in _FIELDS]],
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans) per row of ``docs``; spans are accepted detections in words."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<start: int, end: int, label: string, confidence: double>>",
    )
