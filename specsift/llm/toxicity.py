"""Toxicity by nearest labelled examples, exact TF-IDF cosine.

Training takes labelled documents only: up to ``MAX_EXAMPLES`` of each class
(smallest hashes of the id).  Terms are a text's lower-cased words and their
first 3 to 8 bytes, so that compounds of one stem meet.  Every term of the
examples, of either class, spans the space; document frequencies are
counted over all documents, and weights are
(1 + ln tf) x ln((N + 1) / (df + 1)).

The examples form a block-max inverted index.  They are ordered so that like
stands with like (halved across principal directions of a sketch) and cut into
blocks of at most ``BLOCK`` and groups of ``GROUP`` blocks.  The ``DENSE_TERMS``
terms that most examples of a group have keep their largest weight in every
block.  A text adds up the other terms exactly; that and the largest weights
bound its cosine with any example of a block.  The group with the best block is
multiplied first; groups without a block that reaches the k-th cosine found there
are skipped.  What is left near the k-th is summed again
in double precision, in a fixed order, so the neighbours are exact (to
``DIGITS`` digits of the cosine) and do not depend on the partitioning.  Votes
are weighted by cosine and by how many labelled documents an example stands for;
isotonic regression on the examples' own leave-one-out votes (made by tasks)
makes them calibrated scores.  A text with none of the terms gets the toxic
share of examples without words.

The model (2 x MAX_EXAMPLES examples and their terms) does not grow with the
input and is broadcast; its terms are those of whole example texts.

Defined results: null and empty texts have no terms; without labelled
documents every score is 0; labels of repeated ids count once each (1 if any
is), null labels and ids never; of rows that repeat an example's id one is the
example, and each is scored; equal cosines rank by example id; long texts are
scored whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .words import ALNUM, Words, _powers, mix, split_words

MAX_EXAMPLES = 4096
DENSE_TERMS = 2048
NEIGHBOURS = 15
#: Examples of a block at most, blocks of a group; texts scored at once; width of the sketch that orders examples.
BLOCK = 64
GROUP = 8
TEXTS = 192
SKETCH = 256
#: Products of exact cosines, or postings that are put in place, at once.
PRODUCTS = 1 << 18
#: 32-bit sums choose candidates, with this margin; cosines are 64-bit sums in
#: a fixed order, rounded to so many digits.
SLACK = np.float32(1e-5)
DIGITS = 6
PREFIXES = range(3, 9)

_U = np.uint64
#: Far apart, so that a beginning is no other word: a small number would only change its first byte.
_SALT = {n: _U((n * 0xD1B54A32D192ED03) % (1 << 64)) for n in PREFIXES}


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] of them), for one i after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word of each word of a slice, hash of each term of the
    distinct words, its word), the terms by word."""
    n = len(words.data)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((words.data.astype(np.uint64) + _U(1)) * power[:n], out=sums[1:])
    whole = mix((sums[words.ends] - sums[words.starts]) * inverse[words.starts])
    # as np.unique, but equal words may be represented by any of them: a faster sort
    order = np.argsort(whole)
    whole = whole[order]
    new = np.ones(len(whole), dtype=bool)
    np.not_equal(whole[1:], whole[:-1], out=new[1:])
    which = np.empty(len(whole), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    whole, at = whole[new], order[new]
    starts, ends = words.starts[at], words.ends[at]
    base, scale, size = sums[starts], inverse[starts], ends - starts
    out = [whole]
    of = [np.arange(len(whole))]
    for length in PREFIXES:
        long = np.flatnonzero(size > length)
        out.append(mix((sums[starts[long] + length] - base[long]) * scale[long] + _SALT[length]))
        of.append(long)
    words_of = np.concatenate(of)
    order = np.argsort(words_of, kind="stable")
    return which, np.concatenate(out)[order], words_of[order]


_slots: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _find(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted hashes ``known``, whether it is there): a table of the
    first place for every value of the hashes' upper bits, made once a worker for
    a large ``known``, then steps."""
    if len(known) < 1 << 16:
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return at, known[at] == h
    shift = _U(64 - len(known).bit_length() - 1)
    if 0 not in _slots or _slots[0][0] is not known:
        starts = np.arange(1 << (64 - int(shift)), dtype=np.uint64) << shift
        _slots[0] = (known, np.searchsorted(known, starts).astype(np.int32))
    at = np.minimum(_slots[0][1][(h >> shift).astype(np.int64)], len(known) - 1)
    here = known[at]
    on = np.flatnonzero(here < h)
    while len(on):
        on = on[at[on] + 1 < len(known)]
        at[on] += 1
        here[on] = known[at[on]]
        on = on[here[on] < h[on]]
    return at, here == h


def _counted(words: Words, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times), by text and term: indexes of the vocabulary's
    terms, or without a vocabulary the hashes of all terms."""
    which, h, of = _terms(words)
    known = np.unique(h) if vocabulary is None else vocabulary
    if not len(known) or not len(h):
        none = np.zeros(0, np.int64)
        return none, none if vocabulary is not None else np.zeros(0, np.uint64), none
    at, ok = _find(known, h)
    at, of = at[ok], of[ok]
    size = np.bincount(of, minlength=int(which.max()) + 1)
    first = np.cumsum(size) - size
    cells = np.repeat(words.doc_of(), size[which]) * len(known) + at[_ranges(first[which], size[which])]
    pair, times = np.unique(cells, return_counts=True)
    doc, at = np.divmod(pair, len(known))
    return doc, known[at] if vocabulary is None else at, times


def _frequencies(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df, n = np.zeros(len(known) + 1, dtype=np.int64), 0
        for batch in batches:
            for words in split_words(batch.column("text"), ALNUM):
                df[:-1] += np.bincount(_counted(words, known)[1], minlength=len(known))
                n += len(words.rows)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "df"])

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the terms of a task's texts, once a slice."""
    for batch in batches:
        for words in split_words(batch.column("text"), ALNUM):
            if len(words.starts):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_terms(words)[1]).view(np.int64))], names=["h"])


def weigh(idf: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A text's weights, of length 1 (or 0)."""
    w = (1 + np.log(times)) * idf[at]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm > 0 else w


def sketch(at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Signed sums of the weights in ``SKETCH`` buckets: enough to find a good order."""
    signed = np.where((at * np.int64(0x9E3779B1) >> 16) & 1, weights, -weights)
    return np.bincount(at % SKETCH, signed, minlength=SKETCH).astype(np.float32)


def _vectors(space):
    """Terms (4 bytes each), weights (4 bytes each) and sketch of every example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = space.value
        for batch in batches:
            for words in split_words(batch.column("text"), ALNUM):
                part = batch.slice(words.rows.start, len(words.rows))
                rows = [(at.astype("<i4"), weigh(idf, at, times).astype("<f4")) for at, times in _cells(words, vocabulary)]
                binary = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), binary(a for a, _ in rows), binary(w for _, w in rows), binary(sketch(a, w) for a, w in rows)],
                    names=["doc_id", "label", "terms", "weights", "sketch"],
                )

    return run


def _blocks(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of at most ``size``, halved again and again across their
    principal direction, so that like stands with like."""
    done, todo = [], [np.arange(len(vectors))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            done.append(np.sort(own))
            continue
        x = vectors[own] - vectors[own].mean(axis=0)
        v = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(8):
            v = x.T @ (x @ v)
            v /= max(np.linalg.norm(v), 1e-30)
        order = own[np.argsort(x @ v, kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


@dataclass
class Index:
    """Weighted examples, numbered block by block: the terms and weights of
    example e are ``own[e]:own[e + 1]`` of (``terms``, ``weights``)."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    stands: np.ndarray
    begins: np.ndarray  # first example of every block
    own: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    searcher: Searcher | None = None  # a worker's

    def vote(self, found: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        w = cosines * self.stands[found]
        return float((w * self.labels[found]).sum() + 0.01 * prior) / float(w.sum() + 0.01)


class Searcher:
    """What a worker makes of an index.

    A group is a run of ``GROUP`` blocks; its ``DENSE_TERMS`` most frequent terms
    are columns of ``matrix`` (a row for each example), with their largest weight
    in every block in ``top``; ``columns`` holds group * width + column, term by
    term.  All other postings stay sparse, in ``postings``, the longest lists first
    so that those read often stand close together.
    """

    def __init__(self, index: Index):
        self.index = index
        n, n_terms = len(index.ids), len(index.idf)
        blocks = range(0, len(index.begins), GROUP)
        self.edges = np.append(index.begins[blocks], n)  # first example of every group
        self.matrix = np.zeros((n, min(DENSE_TERMS, n_terms)), np.float32)
        rest, self.top, heavies = np.ones(len(index.terms), dtype=bool), [], [np.zeros(0, np.int64)]
        for g, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            own = slice(index.own[a], index.own[b])
            term = index.terms[own]
            heavy = np.argpartition(-np.bincount(term, minlength=n_terms), self.matrix.shape[1] - 1)[: self.matrix.shape[1]]
            heavies.append(heavy)
            column = np.full(n_terms, -1, np.int32)
            column[heavy] = np.arange(len(heavy))
            column = column[term]
            on = column >= 0
            example = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(index.own[a : b + 1]))
            self.matrix[example[on], column[on]] = index.weights[own][on]
            rest[own] = ~on
            self.top.append(np.maximum.reduceat(self.matrix[a:b], index.begins[blocks[g] : blocks[g] + GROUP] - a, axis=0).T.copy())
        heavy = np.concatenate(heavies)
        self.columns = np.argsort(heavy, kind="stable").astype(np.int32)
        self.dense_size = np.bincount(heavy, minlength=n_terms).astype(np.int32)
        self.dense_first = (np.cumsum(self.dense_size) - self.dense_size).astype(np.int32)
        # postings of the rest, example and weight side by side
        at = np.flatnonzero(rest).astype(np.int32)
        self.size = np.bincount(index.terms[at], minlength=n_terms).astype(np.int32)
        self.first = np.empty_like(self.size)
        order = np.argsort(-self.size, kind="stable")
        self.first[order] = np.cumsum(self.size[order]) - self.size[order]
        at = at[np.argsort(self.first[index.terms[at]], kind="stable")]
        self.postings = np.empty(len(at), [("example", np.int32), ("weight", np.float32)])
        for i in range(0, len(at), PRODUCTS):
            own = slice(i, i + PRODUCTS)
            self.postings["example"][own] = np.searchsorted(index.own, at[own], side="right") - 1
            self.postings["weight"][own] = index.weights[at[own]]
        self.steps = np.arange(1 << 16)
        self.visited = self.of = 0  # (text, example) pairs multiplied, and all

    def _parts(self, cells: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x examples: sums over the sparse postings; texts x groups x
        columns; the places in these that have a weight)."""
        sums = np.zeros((len(cells), len(self.index.ids)))
        dense, filled = np.zeros((len(cells), len(self.edges) - 1, self.matrix.shape[1]), np.float32), []
        for i, (at, weights) in enumerate(cells):
            size = self.size[at].astype(np.int64)
            some = np.flatnonzero(size)
            size = size[some]
            stop = np.cumsum(size)
            places = np.repeat(self.first[at[some]] - stop + size, size)
            if len(places) > len(self.steps):
                self.steps = np.arange(2 * len(places))
            places += self.steps[: len(places)]
            own = self.postings.take(places)
            product = np.repeat(weights[some], size)
            product *= own["weight"]
            sums[i] = np.bincount(own["example"], product, minlength=sums.shape[1])
            size = self.dense_size[at]
            own = self.columns[_ranges(self.dense_first[at], size)]
            dense[i].reshape(-1)[own] = np.repeat(weights, size)
            filled.append(np.sort(own) + np.int64(i * dense[i].size))
        return sums, dense, np.concatenate(filled)

    def nearest(self, cells: list[tuple[np.ndarray, np.ndarray]], k: int, skip: np.ndarray | None = None):
        """(examples, cosines) of the k nearest of each text (terms, weights), the
        nearest first, ties by id; ``skip``: an example of each that doesn't count."""
        index, n = self.index, len(cells)
        if not len(index.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        sums, dense, places = self._parts(cells)
        if skip is not None:
            sums[np.arange(n), skip] = -np.inf
        # a block's bound: what is summed already, and the largest weights of all other terms
        blocks = np.maximum.reduceat(sums, index.begins, axis=1).astype(np.float32)
        blocks += np.hstack([dense[:, g] @ top for g, top in enumerate(self.top)])
        bound = np.maximum.reduceat(blocks, np.arange(0, blocks.shape[1], GROUP), axis=1)
        scores = np.full(sums.shape, -np.inf, np.float32)
        bar = np.full(n, SLACK, np.float32)
        best = bound.argmax(axis=1)
        first = best[:, None] == np.arange(dense.shape[1])
        # the group of the best block, then all groups with a block that can still reach the k-th
        for todo in (lambda: first, lambda: ~first & (bound >= bar[:, None])):
            wanted = todo()
            for g in np.flatnonzero(wanted.any(axis=0)).tolist():
                text, own = np.flatnonzero(wanted[:, g]), slice(self.edges[g], self.edges[g + 1])
                out = dense[text, g] @ self.matrix[own].T
                out += sums[text, own]
                scores[text, own] = out
                self.visited += out.size
                if wanted is first and out.shape[1] > k:
                    bar[text] = np.maximum(bar[text], np.partition(out, -k, axis=1)[:, -k] - SLACK)
        self.of += scores.size
        text, found = np.nonzero(scores >= bar[:, None])
        near = scores[text, found]
        parts = np.searchsorted(text, np.arange(n + 1)).tolist()
        for i, (a, b) in enumerate(zip(parts, parts[1:])):
            if b - a > k:
                bar[i] = np.partition(near[a:b], -k)[-k] - SLACK
        text, found = text[near >= bar[text]], found[near >= bar[text]]
        cosines = np.round(sums[text, found] + self._exact(dense, places, text, found), DIGITS)
        best = np.lexsort((index.ids[found], -cosines, text))
        best = best[cosines[best] > 0]
        text, found, cosines = text[best], found[best], cosines[best]
        parts = np.searchsorted(text, np.arange(n + 1)).tolist()
        return [(found[a : min(a + k, b)], cosines[a : min(a + k, b)]) for a, b in zip(parts, parts[1:])]

    def _exact(self, dense: np.ndarray, places: np.ndarray, text: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The share of the columns in the cosines of (text, example) pairs, summed
        in double precision over the columns of each text, in their order."""
        _, groups, width = dense.shape
        out = np.zeros(len(found))
        weights = dense.reshape(-1)[places]
        of = text * groups + np.searchsorted(self.edges, found, side="right") - 1
        first, stop = np.searchsorted(places, of * width), np.searchsorted(places, (of + 1) * width)
        size = stop - first
        row = np.concatenate([[0], np.cumsum(size)])
        begin = 0
        while begin < len(found):  # a bounded number of products at once
            end = max(int(np.searchsorted(row, row[begin] + PRODUCTS, side="right")) - 1, begin + 1)
            own = slice(begin, end)
            at = _ranges(first[own], size[own])
            product = weights[at].astype(float)
            product *= self.matrix.reshape(-1)[places[at] + np.repeat((found[own] - of[own]) * width, size[own])]
            out[own] = np.bincount(np.repeat(np.arange(end - begin), size[own]), product, minlength=end - begin)
            begin = end
        return out


def build_index(idf: np.ndarray, ids, labels, stands, vectors: list[tuple], sketches: np.ndarray) -> Index:
    """``vectors``: (terms, weights) of every example, as arrays or their bytes, none without terms."""
    ids, labels, stands = np.asarray(ids, np.int64), np.asarray(labels, float), np.asarray(stands, float)
    blocks = _blocks(sketches, BLOCK) if len(vectors) else []
    order = np.concatenate([np.zeros(0, np.int64), *blocks])
    joined = lambda i, kind: np.frombuffer(b"".join(memoryview(vectors[e][i]).cast("B") for e in order), kind)
    terms = joined(0, "<i4")
    sizes = [memoryview(vectors[e][0]).nbytes // 4 for e in order]
    begins = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)[: len(blocks)]
    own = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return Index(idf, ids[order], labels[order], stands[order], begins, own, terms, joined(1, "<f4"))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit: (points, values), for interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # value, weight, lowest and highest x
    for a, b, c in zip(x[order], y[order], w[order]):
        if pools and pools[-1][3] == a:
            p = pools[-1]
            pools[-1] = [(p[0] * p[1] + b * c) / (p[1] + c), p[1] + c, p[2], a]
        else:
            pools.append([b, c, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            q, p = pools.pop(), pools.pop()
            pools.append([(p[0] * p[1] + q[0] * q[1]) / (p[1] + q[1]), p[1] + q[1], p[2], q[3]])
    return np.array([v for p in pools for v in p[2:]]), np.array([p[0] for p in pools for _ in (0, 1)])


def _searcher(index: Index) -> Searcher:
    """One a worker, kept with the broadcast index that every task gets; it holds
    all weights itself, so those of the index are given up."""
    if index.searcher is None:
        index.searcher = Searcher(index)
        index.terms = index.weights = np.zeros(0)
    return index.searcher


def _nearest(index: Index, cells: list[tuple[np.ndarray, np.ndarray]], skip: np.ndarray | None = None):
    """The nearest examples of texts (terms, times), ``TEXTS`` at a time at most."""
    searcher = _searcher(index)
    edges = np.linspace(0, len(cells), -(-len(cells) // TEXTS) + 1).astype(int).tolist()
    for a, b in zip(edges, edges[1:]):
        part = [(at, weigh(index.idf, at, times)) for at, times in cells[a:b]]
        yield from searcher.nearest(part, NEIGHBOURS, None if skip is None else skip[a:b])


def _cells(words: Words, vocabulary: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    doc, at, times = _counted(words, vocabulary)
    bounds = np.searchsorted(doc, np.arange(len(words.rows) + 1)).tolist()
    return [(at[i:j], times[i:j].astype(float)) for i, j in zip(bounds, bounds[1:])]


@dataclass
class Model:
    vocabulary: np.ndarray
    index: Index
    prior: float


@dataclass
class Calibration:
    """From votes to scores; ``nothing``: the score of a text without neighbours."""

    nothing: float
    points: np.ndarray
    values: np.ndarray

    def score(self, vote: float, some: bool) -> float:
        return min(max(float(np.interp(vote, self.points, self.values)) if some else self.nothing, 0.0), 1.0)


def _votes(model):
    """Leave-one-out votes of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        by_id = np.argsort(m.index.ids)
        for batch in batches:
            for words in split_words(batch.column("text"), ALNUM):
                ids = batch.column("doc_id").slice(words.rows.start, len(words.rows)).to_numpy()
                cells = _cells(words, m.vocabulary)
                some = np.flatnonzero([len(at) > 0 for at, _ in cells])
                own = by_id[np.searchsorted(m.index.ids[by_id], ids[some])]
                votes = [m.index.vote(f, c, m.prior) for f, c in _nearest(m.index, [cells[i] for i in some], own)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(votes, pa.float64())], names=["doc_id", "vote"])

    return run


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple | None:
    """(broadcast model, calibration) of ``labelled`` (id, label 0/1); term
    statistics cover all ``docs``; None without labelled documents."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    rows = rows.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    pick = lambda y: rows.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
    picked = F.broadcast(pick(0).unionByName(pick(1)))  # at most 2 x MAX_EXAMPLES ids
    examples = write_stage(source.join(picked, "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"]), "toxic-examples")

    context = docs.sparkSession.sparkContext
    hashes = examples.select("text").mapInArrow(_distinct, "h long").distinct().toArrow()
    vocabulary = np.sort(hashes["h"].to_numpy().view(np.uint64))
    df = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    counts = source.select("text").mapInArrow(_frequencies(context.broadcast(vocabulary)), "at long, df long")
    counted = counts.groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    df[counted["at"].to_numpy()] = counted["df"].to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1))

    space = context.broadcast((vocabulary, idf))
    found = examples.mapInArrow(_vectors(space), "doc_id long, label int, terms binary, weights binary, sketch binary").toArrow()
    ids, labels = found["doc_id"].to_numpy(), found["label"].to_numpy().astype(float)
    have = {y: max(int((labels == y).sum()), 1) for y in (0, 1)}
    stands = np.array([sizes[y] / have[y] for y in labels])
    prior = float((labels * stands).sum() / stands.sum()) if len(labels) else 0.0
    parts = [(t.as_buffer(), w.as_buffer()) for t, w in zip(found["terms"], found["weights"])]
    some = np.array([t.size > 0 for t, _ in parts], dtype=bool)
    nothing = float((labels * stands)[~some].sum() / stands[~some].sum()) if not some.all() else prior
    by_id = np.argsort(ids, kind="stable")
    by_id = by_id[some[by_id]] if len(by_id) else by_id
    sketches = np.frombuffer(b"".join(found["sketch"][int(i)].as_buffer() for i in by_id), "<f4").reshape(-1, SKETCH)
    index = build_index(idf, ids[by_id], labels[by_id], stands[by_id], [parts[i] for i in by_id], sketches)
    del parts, found, sketches, hashes, counted
    pa.default_memory_pool().release_unused()

    model = context.broadcast(Model(vocabulary, index, prior))
    own = examples.repartition(F.xxhash64("doc_id")).mapInArrow(_votes(model), "doc_id long, vote double").toArrow()
    at = np.argsort(index.ids)
    of = at[np.searchsorted(index.ids[at], own["doc_id"].to_numpy())]
    points, values = isotonic(own["vote"].to_numpy(), index.labels[of], index.stands[of]) if len(of) else (np.zeros(1), np.full(1, prior))
    return model, Calibration(nothing, points, values)


def _scored(model, calibration: Calibration):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for words in split_words(batch.column("text"), ALNUM):
                found = list(_nearest(m.index, _cells(words, m.vocabulary)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(words.rows.start, len(words.rows)),
                        pa.array([calibration.score(m.index.vote(f, c, m.prior), len(f) > 0) for f, c in found], pa.float64()),
                        pa.array([m.index.ids[f[:3]].tolist() for f, _ in found], pa.list_(pa.int64())),
                        pa.array([c[:3].tolist() for _, c in found], pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "score", "nearest", "cosines"],
                )

    return run


def score_toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, nearest, cosines) per row of ``docs``: a calibrated
    probability and the three nearest labelled examples as evidence."""
    trained = train(docs, labelled, id_col, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if trained is None:
        none = lambda kind: F.array().cast(f"array<{kind}>")
        return source.select("doc_id", F.lit(0.0).alias("score"), none("long").alias("nearest"), none("double").alias("cosines"))
    return source.mapInArrow(_scored(*trained), "doc_id long, score double, nearest array<long>, cosines array<double>")
