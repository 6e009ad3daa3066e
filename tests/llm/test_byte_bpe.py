import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kotonoha.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
CODEC = byte_bpe.Codec(RANKS, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_as_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for sep in ("a", " ", "1", "!"):
        for at in range(0, len(points), 20_000):
            text = sep.join(points[at : at + 20_000])
            assert ids(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 50_000, "ab " * 30_000, "\n \t" * 999, "<|endoftext|>", "\u0000\u0085\u001c x", "ＡＢ漢字 かな"])
def test_edges(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_query(spark):
    rows = [(1, "Hello wörld", "x"), (2, None, "y"), (3, "", "z"), (4, "Hello wörld", "x"), (None, "q", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in byte_bpe.digests(df, PATH, P.PATTERN).collect()}
    for i, text, _ in rows:
        want = LIBRARY.encode_ordinary(text or "")
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    arrays = {r.doc_id: r.a for r in byte_bpe.encode(df, PATH, P.PATTERN).select("doc_id", byte_bpe.unpacked().alias("a")).collect()}
    assert arrays[1] == LIBRARY.encode_ordinary("Hello wörld") and arrays[2] == []
    apart = byte_bpe.decode(byte_bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(map(str, apart.collect())) == sorted(map(str, byte_bpe.round_trip(df, PATH, P.PATTERN).collect()))
    assert byte_bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
