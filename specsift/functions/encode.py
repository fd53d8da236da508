"""Text encoder (F19): signed feature hashing.

Each lower-case word token t is hashed with md5; the first 8 hex digits give
its bucket (mod ``dims``) and the parity of the 9th digit its sign.  A text's
vector is the signed count per bucket.  Counts are small integers, so dot
products are exact in float64 and cosine = dot / sqrt(|a|^2 |b|^2) is
reproducible bit for bit by any engine.

On the Spark side the encoder yields, per row, the array of signed bucket ids
``sign * (bucket + 1)`` (``token_ids``, which hashes every distinct word of an
Arrow batch once); dense vectors are assembled inside the Arrow-batched scorer.  A model-backed encoder plugs in as a pandas UDF
that returns ``array<float>`` (see ``operators.vectors.dense_from_model``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import replacement_words, tokens


#: Distinct words that are hashed at once.
WORDS = 1 << 15


def signed_bucket(token: str, dims: int) -> int:
    h = hashlib.md5(token.encode(), usedforsecurity=False).digest()
    bucket = int.from_bytes(h[:4]) % dims
    return -(bucket + 1) if h[4] & 16 else bucket + 1


def token_ids(toks: Column, dims: int, rewrite: bool = False) -> Column:
    """array<int> of signed bucket ids, one per token (repeats kept); null for null.

    With ``rewrite`` a token that is an operator's name gives the ids of its
    replacement: the ids of ``normalize_operators(text)`` from the tokens of
    ``text``.  Every distinct word of a batch is hashed once.
    """
    rewrites = replacement_words() if rewrite else {}

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        words = column.flatten().dictionary_encode()
        size = np.ones(len(words.dictionary), np.int64)
        known = {i: rewrites[w] for w in rewrites if (i := words.dictionary.index(w).as_py()) >= 0}
        for i, own in known.items():
            size[i] = len(own)
        first = np.cumsum(size) - size
        hashed = np.zeros(int(size.sum()), np.int32)
        for at in range(0, len(size), WORDS):
            part = words.dictionary.slice(at, WORDS).to_pylist()
            some = size[at : at + WORDS] > 0  # the others have no place
            hashed[first[at : at + WORDS][some]] = np.fromiter((signed_bucket(w, dims) for w in part), np.int32, len(part))[some]
        for i, own in known.items():
            hashed[first[i] : first[i] + size[i]] = [signed_bucket(w, dims) for w in own]
        code = words.indices.to_numpy(zero_copy_only=False)
        end = np.concatenate([[0], np.cumsum(size[code])]).astype(np.int64)
        at = np.repeat(first[code] - end[:-1], size[code]) + np.arange(end[-1])
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = end[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashed[at], pa.int32()))
        return lists.filter(column.is_valid()).take(_places(column)) if column.null_count else lists

    return ids(toks)


def _places(column: pa.Array) -> pa.Array:
    """For every row its number among the rows that are not null; null for null."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(np.cumsum(valid) - 1, pa.int64(), mask=~valid)


def hashed_ids(text, dims: int) -> Column:
    """array<int> of signed bucket ids, one per token (repeats kept)."""
    return token_ids(tokens(text), dims)


def window_hashes(words: Column, n: int) -> Column:
    """array<long>: a hash of every ``n`` consecutive words, in order.  Every
    distinct word of a batch is hashed once."""

    @F.arrow_udf("array<long>")
    def hashes(column: pa.Array) -> pa.Array:
        coded = column.flatten().dictionary_encode()
        known = [hashlib.blake2b(w.encode(), digest_size=8).digest() for w in coded.dictionary.to_pylist()]
        word = np.frombuffer(b"".join(known), np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
        total = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for j in range(n):  # a polynomial modulo 2**64
            total = total * np.uint64(0x9E3779B97F4A7C15) + word[j : j + len(total)]
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        windows = np.maximum(0, lengths - n + 1)
        end = np.concatenate([[0], np.cumsum(windows)])
        at = np.repeat(np.cumsum(lengths) - lengths - end[:-1], windows) + np.arange(end[-1])
        return pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(total[at].view(np.int64)))

    return hashes(words)


def ids_digest(ids) -> list[Column]:
    """n_ids and ids_sum (a sum that any changed id changes) of an id array."""
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)
    return [F.size(ids).alias("n_ids"), total.alias("ids_sum")]


def dense(ids_list, dims: int) -> np.ndarray:
    """Stack a sequence of signed-id arrays into a (rows, dims) float64 count matrix."""
    n = len(ids_list)
    if n == 0:
        return np.zeros((0, dims))
    lens = np.fromiter((0 if a is None else len(a) for a in ids_list), dtype=np.int64, count=n)
    if lens.sum() == 0:
        return np.zeros((n, dims))
    flat = np.concatenate([np.asarray(a, dtype=np.int64) for a in ids_list if a is not None and len(a)])
    rows = np.repeat(np.arange(n), lens)
    idx = rows * dims + (np.abs(flat) - 1)
    return np.bincount(idx, weights=np.sign(flat).astype(np.float64), minlength=n * dims).reshape(n, dims)


def model_encoder(load_model, dims: int):
    """Encoder hook (F19 / UDF surface): ``load_model()`` is called once per
    Python worker and must return ``f(list[str]) -> array (n, dims)``.  The
    result is an iterator pandas UDF producing ``array<float>`` per text,
    batched through Arrow."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for s in batches:
            m = np.asarray(model(s.fillna("").tolist()), dtype=np.float32).reshape(len(s), dims)
            yield pd.Series(list(m))

    return encode
