import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexipress.llm.bpe import CorpusEncoder, MergeReplay, bpe_digests, bpe_encode, read_ranks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return CorpusEncoder(RANKS, P.PATTERN)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    coder = test_any_text.coder = getattr(test_any_text, "coder", None) or CorpusEncoder(RANKS, P.PATTERN)
    lib = test_any_text.lib = getattr(test_any_text, "lib", None) or tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    raw = coder.encode([text])[0]
    assert ids(raw) == lib.encode_ordinary(text)
    assert coder.decode(raw) == text.encode()


def test_white_space_runs(coder, library):
    rng = random.Random(3)
    parts = [" ", "  ", "   ", "\n", "\t", "\x1c", "\x85", "a", "é", "don't", "'s", "23", "--", "日本", "a" * 17, "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert [ids(x) for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_lower_rank_after_a_merge():
    """A vocabulary in which a merge makes a pair of lower rank, and overlapping pairs, follow the order within a word."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"aa": 258, b"ca": 259, b"abcabc": 260}
    lib = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(2000)})
    got = MergeReplay(ranks).encode([w.encode() for w in words])
    assert [ids(x) for x in got] == [lib.encode_ordinary(w) for w in words]


def test_rows(spark, library):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "x y"), (1, "Hello  world"), (4, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    out = bpe_digests(df, RANKS, P.PATTERN).collect()
    expect = sorted((i or 0, len(e := library.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == expect
    full = bpe_encode(df, RANKS, P.PATTERN).where("doc_id = 1").first()
    assert ids(bytes(full.ids)) == library.encode_ordinary("Hello  world") and bytes(full.decoded) == b"Hello  world"
    assert bpe_digests(df.limit(0), RANKS, P.PATTERN).count() == 0
