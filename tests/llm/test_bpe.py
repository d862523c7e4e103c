import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from aerialframe.llm import bpe, queries

PATH = P.path(queries.TOKENIZER)


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_the_library():
    r, enc, vocab = random.Random(1), reference(), bpe.vocabulary(PATH)
    parts = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "'re", "1", "é", "!", " ", "　", "中", "\t", "'S", "’", "😀", "t", "d", "́", "\U00013460", "<|endoftext|>"]
    cases = ["", " ", "'", "x", *("".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000))]
    got = bpe.encode_batch(cases, vocab)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [enc.encode_ordinary(c) for c in cases]


def test_long_runs():
    enc, vocab = reference(), bpe.vocabulary(PATH)
    for text in ("ab" * 5000, " " * 5000, "é!" * 3000, "1" * 5000):
        assert np.frombuffer(bpe.encode_batch([text], vocab)[0], "<u4").tolist() == enc.encode_ordinary(text)


def test_both_merges_agree():
    r, ranks = random.Random(2), bpe.vocabulary(PATH).ranks
    for _ in range(500):
        data = bytes(r.choice(b"abcdthein \xc3\xa9") for _ in range(r.randrange(1, 60)))
        assert bpe._merge_short(data, ranks) == bpe._merge_long(data, ranks)


def test_query_against_the_library(spark):
    enc, d = reference(), "/root/testdata/sf0.001"
    want = set()
    for row in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = enc.encode_ordinary(row.text or "")
        want.add((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op4_byte_bpe(spark, d).collect()} == want


def test_offsets_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "héllo wörld", 9), (2, None, 9), (None, "", 9)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    tokens, ids = bpe.vocabulary(PATH).tokens, np.frombuffer(rows[1].token_ids, "<u4").tolist()
    data, ends = "héllo wörld".encode(), np.frombuffer(rows[1].token_ends, "<i8").tolist()
    assert [data[a:b] for a, b in zip([0, *ends], ends)] == [tokens[i] for i in ids]
    assert bytes(rows[1].decoded) == data
    assert (rows[2].n_tokens, bytes(rows[2].token_ids), bytes(rows[2].decoded), rows[None].n_tokens) == (0, b"", b"", 0)
    assert bpe.encode(df.where("false"), PATH).collect() == []
