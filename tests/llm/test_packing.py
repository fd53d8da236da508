"""Packed pieces give back every document's ids."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_round_trip(spark):
    from specsift.llm.queries import pack

    hard = [None, "", " ", "a  b", "a \n b\n\nc", "x  y", "中文 text \U0001f600 it's", "<|endoftext|> z", "tail "]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode("<|endoftext|> z", add_special_tokens=False).ids[0] == 50256
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, text in docs.collect():
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            own = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(own.tobytes()))
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at & (at - 1)) == 0


def test_clashes_ties_and_empty_tables(spark):
    from specsift.llm.queries import pack

    rows = [(i, "same text in each", 1, 2, 3) for i in range(40)] + [(5, "same text in each", 1, 2, 3), (None, "no id", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, tie int, offset int")
    got = pack(docs).collect()
    n = len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("same text in each").ids) + 1
    assert sum(r.length for r in got if r.doc_id == 5) == 2 * n
    assert sum(r.length for r in got if r.doc_id is not None) == 41 * n
    assert pack(docs.limit(0)).collect() == []
