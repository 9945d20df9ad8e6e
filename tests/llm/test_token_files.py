import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexipress.llm import token_files
from lexipress.llm.elias_fano import EliasFano
from lexipress.storage import fresh_path

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=700), st.sampled_from([1, 1000, 2**50]))
def test_elias_fano(values, scale):
    v = np.array(sorted(x // scale for x in values), np.int64)
    ef, used = EliasFano.from_buffer(memoryview(EliasFano.of(v).to_bytes() + b"tail"))
    assert used == len(EliasFano.of(v).to_bytes())
    assert ef.all().tolist() == v.tolist()
    assert [ef[i] for i in range(0, len(v), 7)] == v[::7].tolist()
    assert all(ef.slice(a, a + 9).tolist() == v[a : a + 9].tolist() for a in range(0, len(v) + 3, 5))


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    size = len(EliasFano.of(v).to_bytes()) * 8 / len(v)
    assert size < 2.2 + np.log2(1000) and EliasFano.of(v)[77_777] == v[77_777]
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


def plain(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    rng = random.Random(1)
    parts = ["the ", "and", "  ", "   ", "\n", " x", "été", "日本", "don't", "9", "--", " \n "]
    rows = [(i * 7 - 100, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(5_000_000_000, "long text " * 20_000), (1, None), (2, ""), (None, "no id")]
    df = spark.createDataFrame([(i, t, "a", 3) for i, t in rows], "doc_id long, text string, part string, start int")
    monkeypatch.setattr(token_files, "FILE_TOKENS", 500)
    monkeypatch.setattr(token_files, "WINDOW_DOCS", 7)
    got = token_files.corpus_token_offsets(df, fresh_path(spark, "tok"), PATH, 2).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0)) == plain(rows)
    assert token_files.corpus_token_offsets(df.limit(0), fresh_path(spark, "tok"), PATH, 2).count() == 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d e"), (2, "f")], "doc_id long, text string")
    got = sorted(map(tuple, token_files.corpus_token_offsets(df, fresh_path(spark, "tok"), PATH, 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 1, 1, 2]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_random_access():
    docs = [[5, 6, 2], [2], [], [65535, 1, 2]]
    file = token_files.TokenFile(token_files.pack([None, -4, 9, 9], [np.array(d, "<u2").tobytes() for d in docs], 2))
    assert [file.tokens(i).tolist() for i in range(4)] == docs and [file.doc_id(i) for i in range(4)] == [None, -4, 9, 9]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", "'s", "don't", "\x1c", "\x85", "\0", "été", "<|endoftext|>", "½", "a1b2"])), max_size=12))
def test_encoder_agrees_with_whole_texts(parts):
    coder = test_encoder_agrees_with_whole_texts.coder = getattr(test_encoder_agrees_with_whole_texts, "coder", None) or token_files.TokenEncoder(PATH)
    text = "".join(parts)
    assert np.frombuffer(coder.encode([text])[0], "<u2").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
