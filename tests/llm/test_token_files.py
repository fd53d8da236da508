"""Token files: exact round trip against the plain encoder, and the coding."""

import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from specsift.llm import token_files
from specsift.llm.elias_fano import SAMPLE, EliasFano

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
FAST = {"ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@functools.cache
def plain():
    return Tokenizer.from_file(VOCABULARY)


def expected(rows, end_id=2):
    """{doc_id: (start, n_tokens, crc)} of rows with distinct ids."""
    encode, out, at = plain(), {}, 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(encode.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
        out[doc] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=3 * SAMPLE), st.data())
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, data):
    x = np.sort(np.array(values, dtype=np.int64))
    coded, end = EliasFano.from_bytes(b"?" + EliasFano.encode(x).to_bytes(), 1)
    assert (coded.slice(0, len(x)) == x).all()
    if values:
        i = data.draw(st.integers(0, len(x) - 1))
        assert coded.select(i) == x[i]
        assert (coded.slice(i, len(x)) == x[i:]).all()


def test_elias_fano_space():
    x = np.cumsum(np.random.default_rng(7).integers(1, 2000, 100_000))
    assert len(EliasFano.encode(x).to_bytes()) * 8 < len(x) * (2.2 + np.log2(x[-1] / len(x)))


@given(st.text(alphabet=st.sampled_from("ab Z\n\t\r\x0b\x1c\x85\xa0\u2009\u0301éß'ſ12_.<|中🙂"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_fast_ids_are_equal(text):
    fast = token_files.encoder(VOCABULARY, *FAST.values())
    assert fast.ids(text).tolist() == plain().encode(text, add_special_tokens=False).ids


HARD = [None, "", " ", "a  b", "a \n b\n\nc", "x\u00a0 y", "中文 text \U0001f600 it's", "<|endoftext|> z", "tail ", "é" * 5000]


def test_query_equals_plain_encoding(spark):
    from specsift.llm.queries import op13_token_files

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op13_token_files(spark, SF).collect()}
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("shard_bytes", [1, 1 << 20])
def test_hard_rows(spark, shard_bytes):
    rows = [(7 * i - 30, t) for i, t in enumerate(HARD)] + [(-(2**63), "low"), (2**63 - 1, "high")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start int, ids int")
    folder = token_files.write_token_files(docs, VOCABULARY, **FAST, shard_bytes=shard_bytes)
    found = token_files.read_token_files(spark, folder).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected(rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in found)


def test_repeats_and_null_ids(spark):
    rows = [(None, "n"), (None, None), (3, "c"), (3, "c"), (3, "other"), (1, "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = token_files.write_token_files(docs, VOCABULARY, **FAST)
    found = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 6 + [1] * 3 + [3] * 9
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    encode = plain()
    want = sorted((-1 if d is None else d, *encode.encode(t or "").ids) for d, t in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, *np.frombuffer(r.ids, "<u4")[:-1]) for r in found)
    assert got == want


def test_one_document_by_select(spark, scratch):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(50)], "doc_id long, text string").coalesce(1)
    folder = token_files.write_token_files(docs, VOCABULARY, **FAST, folder=f"file://{scratch}/tokens", end_id=9)
    encode = plain()
    for r in spark.read.parquet(f"{folder}/manifest").collect():
        shard = token_files.Shard(f"{folder}/ids", r.shard)
        for i in range(len(shard)):
            doc = shard.numbers(i, i + 1)[0].as_py()
            assert shard.document(i).tolist() == encode.encode("word " * doc).ids + [9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_files(spark, token_files.write_token_files(docs, VOCABULARY)).count() == 0
