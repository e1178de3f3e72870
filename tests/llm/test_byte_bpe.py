"""The encoder against plain merging, the public library and a round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe
from plumbline.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


ODD = [
    "", " ", "a\x1cb", "\x85 x", "​ ᠎ q", "x \n\n y", "  \t a  ", "日本語テキスト 12３", "🙂🙂 I'll 'LL",
    "\x00\x7f", "ab" * 3000, " " * 700 + "x", "İı ſ'ſ", "<|endoftext|>",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(encoder, library, text):
    data = encoder.encode(text)
    assert ids(data) == library.encode_ordinary(text)
    assert encoder.decode(data) == text.encode()


def test_random_pieces_equal_plain_merging(encoder):
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.choice(b"aeionrst th\xc3\xa9\xff") for _ in range(rng.randint(1, 24)))
        assert encoder.backtrack(data) == encoder.merged(data)


def test_small_vocabularies_equal_plain_merging():
    rng = random.Random(4)
    for _ in range(40):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 256 + 25:
            made = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
            if made not in tokens:
                tokens.append(made)
        small = byte_bpe.Encoder({t: i for i, t in enumerate(tokens)}, public_tokenizers.PATTERN)
        for _ in range(40):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
            assert small.backtrack(data) == small.merged(data)


def test_bounded_tables(encoder):
    small = byte_bpe._Memo(lambda x: x + 1, 3)
    assert [small[i] for i in (1, 2, 3, 4, 1)] == [2, 3, 4, 5, 2] and len(small) <= 3


def test_cases(spark):
    rows = [(1, "same text"), (1, "same text"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    n = len(byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN).encode("same text")) // 4
    assert sorted(r.n_tokens for r in got) == [0, 0, n, n]
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256(x).hexdigest() for x in (b"same text", b"")}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    expected = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        own = library.encode_ordinary(r.text)
        data = np.array(own, "<u4").tobytes()
        expected[r.doc_id] = (len(own), hashlib.sha256(data).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    got = QUERIES["op8_byte_bpe"](spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == expected
