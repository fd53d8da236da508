"""Ranked lexical search with the Best Position Algorithm.

Each document adds, for a term it holds, a whole-number impact; an item's score
of a document is the sum over the item's terms, repeats included.

The index is cut into shards of documents (bounded numbers of postings).  A
shard keeps, for every term, the *impact list*: its postings by falling impact,
and for every document its terms with the *positions* they have in those lists,
which is what a direct access reads.

For an item, a shard reads its lists from the top in rounds of growing depth
(sorted access).  A document seen for the first time is scored at once through
direct accesses to all lists of the item, which also marks its positions there
as seen.  A list's *best position* is the last one before the first position
not seen; a document not seen anywhere stands behind the best position of every
list, so the sum of the impacts there bounds its score - tighter than the last
positions read.  The shard stops when that bound is strictly below its k-th
best score; equal scores are never cut.  The best k of every shard meet in one
window per item.

Corpus-wide counts (N, L, document frequencies) come from all documents.  Terms
are compared byte by byte.  Items whose distinct terms exceed ``MAX_TERMS`` in
all are answered in several passes of bounded vocabulary.

Defined results: a null or empty text has no terms and never appears; items
without a known term give no rows; rows that repeat an item's id and text count
once; documents' rows count one each, repeated or not; documents without an id
rank behind equal scores; an empty table gives no rows.  Other columns of the
inputs are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import write_stage
from .words import ALNUM, split_words

#: Distinct terms of the items of one pass, postings of a shard, first depth of sorted access.
MAX_TERMS = 200_000
SHARD_POSTINGS = 2_000_000
DEPTH = 64

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def term_list(text: str | None) -> list[str]:
    """Terms of a text in order, with repeats; only A-Z are lower-cased."""
    return _TERM.findall((text or "").translate(_LOWER))


class Vocabulary:
    """Finds the words of a slice that are one of ``terms``."""

    def __init__(self, terms: list[str]):
        self._raw = [t.encode() for t in terms]
        self._lengths = {len(t) for t in self._raw}
        own = np.frombuffer(b" ".join(self._raw), dtype=np.uint8) if terms else np.zeros(0, np.uint8)
        found = next(split_words(pa.array([own.tobytes().decode()]), ALNUM)) if terms else None
        h = found.hashes() if terms else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self._hash, self._term = h[order], order.astype(np.int64)
        self._by_length: dict[int, np.ndarray] = {}

    def _bytes(self, length: int) -> np.ndarray:
        """Bytes of the terms of this length, in a row each (others are zeros)."""
        if length not in self._by_length:
            rows = [t if len(t) == length else bytes(length) for t in self._raw]
            self._by_length[length] = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, length)
        return self._by_length[length]

    def find(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(word number, term number) of the words that are terms."""
        if not len(self._hash) or not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self._hash, h), len(self._hash) - 1)
        hit = np.flatnonzero(self._hash[at] == h)
        term = self._term[at[hit]]
        length = words.ends[hit] - words.starts[hit]
        good = np.zeros(len(hit), dtype=bool)
        for n in np.unique(length).tolist():  # equal hashes are no proof
            if n not in self._lengths:
                continue
            of = np.flatnonzero(length == n)
            text = words.data[words.starts[hit[of]][:, None] + np.arange(n)]
            good[of] = (text == self._bytes(n)[term[of]]).all(axis=1)
        return hit[good], term[good]


def _forward(terms: list[str]):
    """doc_id, n (terms with repeats), the vocabulary's terms in it and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            for words in split_words(batch.column("text"), ALNUM):
                rows = len(words.rows)
                word, term = vocabulary.find(words)
                doc = np.searchsorted(words.first, word, side="right") - 1
                key, count = np.unique(doc * max(1, len(terms)) + term, return_counts=True)
                doc, term = key // max(1, len(terms)), key % max(1, len(terms))
                ends = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(words.rows.start, rows),
                        pa.array(words.counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int64))),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


class ImpactShard:
    """Impact lists of a set of documents, with direct access by document."""

    def __init__(self, first: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        """Documents' postings one after another (``first``: offsets), sorted by term in each."""
        self.first, self.term, self.impact = first, term, impact
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((doc, -impact, term))
        self.lists = np.searchsorted(term[order], np.arange(n_terms + 1))  # a list's place in the arrays below
        self.doc, self.value = doc[order], impact[order]
        self.place = np.empty(len(order), dtype=np.int64)  # of a document's posting in the lists
        self.place[order] = np.arange(len(order))

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents accessed): all that can be among the k best.

        Every document with a score of the k-th best or more is returned, and
        none without a score.
        """
        begin, end = self.lists[terms], self.lists[terms + 1]
        used = end > begin
        begin, end, repeats_used = begin[used], end[used], repeats[used]
        weight = np.zeros(len(self.lists), dtype=np.int64)
        weight[terms] = repeats
        # `seen` has the item's lists one after another
        size = end - begin
        local = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(local[-1], dtype=bool)
        shift = np.zeros(len(self.lists), dtype=np.int64)
        shift[terms[used]] = local[:-1] - begin
        known = np.zeros(len(self.first) - 1, dtype=bool)
        best_position = local[:-1].copy()  # the first place not seen
        docs, scores, kth = [], [], 0
        read, depth = begin.copy(), DEPTH
        while (read < end).any():
            to = np.minimum(read + depth, end)
            new = np.unique(np.concatenate([self.doc[a:b] for a, b in zip(read, to) if b > a]))
            new = new[~known[new]]
            read, depth = to, 2 * depth
            if len(new):
                known[new] = True
                # direct access: the postings of the new documents in all lists of the item
                length = self.first[new + 1] - self.first[new]
                at = np.repeat(self.first[new] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                term = self.term[at]
                times = weight[term]
                own = np.flatnonzero(times)
                sums = np.concatenate([[0], np.cumsum(self.impact[at] * times)])
                ends = np.cumsum(length)
                score = sums[ends] - sums[ends - length]
                seen[self.place[at[own]] + shift[term[own]]] = True
                docs.append(new)
                scores.append(score)
                top = np.concatenate([top, score]) if len(docs) > 1 else score
                if len(top) >= k:
                    top = np.partition(top, len(top) - k)[len(top) - k :]
                    kth = int(top.min())
            bound = 0
            for i in range(len(size)):
                a, b = best_position[i], local[i + 1]
                if a < b:
                    gap = seen[a:b].argmin()
                    a = best_position[i] = b if seen[a + gap] else a + gap
                if a < b:
                    # the impact at the place after the best position bounds what is not seen
                    bound += int(self.value[begin[i] + a - local[i]]) * int(repeats_used[i])
            if bound < kth:
                break
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        doc, score = np.concatenate(docs), np.concatenate(scores)
        kept = (score > 0) & (score >= kth)
        return doc[kept], score[kept], int(known.sum())


def _impacts(n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """w * ((10**9 tf) div (1000 tf + 8 m)) of every posting."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([25 + 75 * int(x) * n_docs // n_all for x in n], dtype=np.int64)
    else:
        m = 25 + (75 * n * n_docs) // n_all
    return weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(first))))


def _search(items: list[tuple], n_docs: int, n_all: int, weights: np.ndarray, k: int):
    """items: (number, term numbers, repeats)."""

    def shards(batches: Iterator[pa.RecordBatch]):
        parts, size = [], 0
        for batch in batches:
            lengths = batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(lengths):
                room = SHARD_POSTINGS - size
                take = max(1 if not parts else 0, int(np.searchsorted(np.cumsum(lengths[at:]), room, side="right")))
                if take:
                    parts.append(batch.slice(at, take))
                    size += int(lengths[at : at + take].sum())
                    at += take
                if at < len(lengths):
                    yield pa.Table.from_batches(parts)
                    parts, size = [], 0
        if parts:
            yield pa.Table.from_batches(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches):
            flat = lambda c: np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy(zero_copy_only=False) for x in c.chunks)])
            n = table.column("n").to_numpy().astype(np.int64)
            lengths = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in table.column("terms").chunks])
            first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            term, tf = flat(table.column("terms")).astype(np.int64), flat(table.column("tfs")).astype(np.int64)
            shard = ImpactShard(first, term, _impacts(n, first, term, tf, weights, n_docs, n_all), len(weights))
            ids = table.column("doc_id").combine_chunks()
            empty = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            rows = []
            for item, terms, repeats in items:
                doc, score, _ = shard.best(terms, repeats, k)
                top = np.lexsort((number[doc], empty[doc], -score))[:k]
                rows += [(item, None if empty[d] else int(number[d]), int(s)) for d, s in zip(doc[top], score[top])]
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def _answer(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """items: (number, terms with repeats); their distinct terms fit one pass."""
    spark = docs.sparkSession
    terms = sorted({t for _, ts in items for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    forward = write_stage(docs.mapInArrow(_forward(terms), "doc_id long, n long, terms array<int>, tfs array<long>"), "lexical-forward")
    n_docs, n_all = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(terms), dtype=np.int64)
    # a row for each term of the items
    for t, df in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[t] = df
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequency + 1))).astype(np.int64)
    asked = []
    for item, ts in items:
        t, repeats = np.unique([number[x] for x in ts], return_counts=True)
        asked.append((item, t.astype(np.int64), repeats.astype(np.int64)))
    held = forward.where(F.size("terms") > 0)
    return held.mapInArrow(_search(asked, n_docs, max(1, n_all), weights, k), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item, rank, doc_id, score of each item's k best documents; the item's
    column keeps its name and type."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    asked = asked.where("text IS NOT NULL").distinct()
    kind = dict(asked.dtypes)["id"]
    blocks, names = _blocks(asked)
    parts = [_answer(source, block, k) for block in blocks]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"`{item_col}` {kind}, rank int, doc_id long, score long")
    found = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
    named = ranked.join(names, "item", "left")
    return named.select(F.col("id").alias(item_col), "rank", "doc_id", "score")


def _blocks(asked: DataFrame) -> tuple[list[list[tuple]], DataFrame]:
    """Items with their terms in blocks of bounded vocabulary, read a block at
    a time, and the table of item numbers."""
    names = write_stage(_numbered(asked), "lexical-items")
    blocks, block, terms = [], [], set()
    for r in names.orderBy("item").select("item", "text").toLocalIterator():
        own = term_list(r.text)
        if not own:
            continue
        if block and len(terms) + len(set(own)) > MAX_TERMS:
            blocks.append(block)
            block, terms = [], set()
        block.append((r.item, own))
        terms.update(own)
    if block:
        blocks.append(block)
    return blocks, names.drop("text")


def _numbered(asked: DataFrame) -> DataFrame:
    return asked.withColumn("item", F.monotonically_increasing_id())
