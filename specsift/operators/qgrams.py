"""Substring facts by q-grams over a dictionary of distinct words.

``gram_index`` keeps, for every distinct word, its substrings of one to four
characters: rows linear in the words' lengths.  A term of up to four
characters is itself a key; a longer one looks up the rarest of its four-grams
and is then verified in the words found.  Both are equi-joins.

``pairs_within`` gives the same pairs in one task: the pieces of the words of
every length that a term has are looked up among the terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_stage

Q = 4
#: Bytes of pieces that are looked up at once.
PIECES = 1 << 22


@dataclass
class GramIndex:
    postings: DataFrame  # gram, word
    counts: DataFrame  # gram, n


def _pieces(word: str, length: int) -> Column:
    """The substrings of ``length`` at every place; shorter at the end."""
    return F.expr(f"transform(sequence(1, length({word})), i -> substring({word}, i, {length}))")


def gram_index(words: DataFrame) -> GramIndex:
    """``words``: distinct, not empty, in column ``word``."""
    all_ = F.array_distinct(F.concat(*[_pieces("word", n) for n in range(1, Q + 1)]))
    postings = write_stage(words.where("word <> ''").select(F.explode(all_).alias("gram"), "word"), "grams")
    return GramIndex(postings, write_stage(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts"))


def substring_pairs(terms: DataFrame, index: GramIndex) -> DataFrame:
    """(term, word) for every distinct term that stands inside a word."""
    whole = F.expr(f"transform(sequence(1, length(term) - {Q - 1}), i -> substring(term, i, {Q}))")
    grams = F.when(F.length("term") <= Q, F.array("term")).otherwise(F.array_distinct(whole))
    t = terms.where("term <> ''").select("term").distinct().select("term", F.explode(grams).alias("gram"))
    n = F.coalesce("n", F.lit(0))
    rarest = t.join(index.counts, "gram", "left").groupBy("term").agg(F.min(F.struct(n, F.col("gram"))).alias("g"))
    # written, so that its size is known: the smaller side of the join is the one that is built
    probe = write_stage(rarest.select("term", F.col("g.gram").alias("gram")), "probes")
    found = probe.join(index.postings, "gram")
    return found.where((F.length("term") <= Q) | F.contains("word", "term")).select("term", "word")


def pairs_within(terms: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term, word) numbers of all pairs where the term stands inside the word;
    both distinct, empty ones in no pair.  Bytes are compared: in UTF-8 a string
    begins and ends in another only where characters do."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(pc.cast(words, pa.binary()).to_pylist()), np.uint8)
    word, at = np.repeat(np.arange(len(words), dtype=np.int32), size), np.arange(len(data), dtype=np.int32)
    rest = np.repeat(np.cumsum(size, dtype=np.int32), size) - at
    lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for length in np.unique(lengths[lengths > 0]).tolist():
        at = at[rest[at] >= length]
        if not len(at):
            break
        own = np.flatnonzero(lengths == length)
        asked = pc.cast(pc.cast(terms.take(pa.array(own)), pa.binary()), pa.binary(length))
        pieces = np.lib.stride_tricks.sliding_window_view(data, length)
        step = max(1, PIECES // length)
        for a in range(0, len(at), step):
            begin = at[a : a + step]
            held = pa.py_buffer(np.ascontiguousarray(pieces[begin]))
            hit = pc.index_in(pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(begin), [None, held]), asked)
            some = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
            found.append((own[hit.drop_null().to_numpy()], word[begin[some]]))
    term, word = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    pair = np.unique(term * max(1, len(words)) + word)
    return pair // max(1, len(words)), pair % max(1, len(words))
