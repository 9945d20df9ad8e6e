import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexipress.llm import gru
from lexipress.llm import lm_score as L

SF = "/root/testdata/sf0.01"


def test_gradients_against_differences(monkeypatch):
    rng = np.random.default_rng(1)
    model = gru.Gru.fresh(9, np.zeros(4), np.zeros((2, 3)), seed=2)
    for name in ("inputs", "state", "to_class", "class_bias", "to_member", "member_bias"):
        setattr(model, name, getattr(model, name).astype(np.float64) * 5)
    tokens, classes, members = rng.integers(0, 9, (5, 3)), rng.integers(0, 4, (5, 3)), rng.integers(0, 3, (5, 3))
    live = np.ones((5, 3), bool)
    live[3:, 1] = False
    h0 = rng.normal(0, 0.5, (3, gru.HIDDEN))

    def loss():
        h, out = h0, 0.0
        for t in range(5):
            h = model.step(tokens[t], h)[0]
            out -= (model.log_chances(h, classes[t], members[t]) * live[t]).sum()
        return out

    grads, _ = gru._gradients(model, tokens, classes, members, live, h0)
    for a, g in zip(model.arrays(), grads, strict=True):
        for i in rng.integers(0, a.size, 6):
            old = a.flat[i]
            a.flat[i] = old + 1e-5
            up = loss()
            a.flat[i] = old - 1e-5
            down = loss()
            a.flat[i] = old
            assert g.flat[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)


def test_score_is_window_free_and_sums_to_one():
    model = gru.Gru.fresh(9, np.zeros(4), np.zeros((2, 3)), seed=2)
    rng = np.random.default_rng(3)
    lengths = np.array([7, 1, 0, 12])
    n = lengths.sum()
    x, c, m = rng.integers(0, 9, n), rng.integers(0, 4, n), rng.integers(0, 3, n)
    assert np.allclose(model.score(x, c, m, lengths, 0, window=3), model.score(x, c, m, lengths, 0, window=100), atol=1e-5)
    h = rng.normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    every = [(k, j) for k in range(2) for j in range(3)] + [(2, 0), (3, 0)]
    assert sum(math.exp(model.log_chances(h, np.array([k]), np.array([j]))[0]) for k, j in every) == pytest.approx(1, abs=1e-5)


def test_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    out = {r.doc_id: r for r in L.lm_scores(docs).collect()}
    assert len(out) == len(rows)
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(L.tokens_of(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t, o = L.tokens_of(r.text), out[r.doc_id]
        assert (o.held_out, o.n_tokens, o.n_known, o.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(t), sum(w in counts for w in t), n)
        assert o.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    held = [o for o in out.values() if o.held_out]
    print("per token", sum(o.score for o in held) / sum(o.n_tokens for o in held), sum(o.base_score for o in held) / sum(o.n_tokens for o in held))
    assert sum(o.score for o in held) > 0.97 * sum(o.base_score for o in held)


def test_counts_by_chunk(spark):
    """Each chunk gets the corpus counts of its words, and each word is named once."""
    rows = [(1, ["a", "b", "c"], [2, 0, 5]), (2, ["c", "a"], [1, 0]), (3, ["d", "b"], [0, 0]), (4, ["a"], [1 << 40])]
    blocks = spark.createDataFrame(rows, "block long, words array<string>, counts array<long>")
    got = L._counts(blocks).collect()
    assert sorted((r.block, r.at, r.c) for r in got) == [(1, 0, 2 + (1 << 40)), (1, 2, 6), (2, 0, 6), (2, 1, 2 + (1 << 40)), (4, 0, 2 + (1 << 40))]
    assert sorted(r.word for r in got if r.word is not None) == ["a", "c"]


def test_sample_grows_with_the_corpus():
    sizes = [L.sample_size(n) for n in (0, 1000, 10**6, 10**9, 10**12, 10**14)]
    assert sizes[:3] == [(0, L.SHARDS), (1000, L.SHARDS), (L.TRAIN_TOKENS, L.SHARDS)]
    assert [w for w, _ in sizes[3:]] == [n // L.TRAIN_SHARE for n in (10**9, 10**12, 10**14)]
    assert all(w / parts <= L.PART_TOKENS for w, parts in sizes) and sizes[3][1] < sizes[4][1] < sizes[5][1]


def test_averages_in_steps(spark, monkeypatch):
    """Many parts give a model, and so scores, like few do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    one = {r.doc_id: r.score for r in L.lm_scores(docs).collect()}
    monkeypatch.setattr(L, "SHARDS", 9)
    monkeypatch.setattr(L, "AVERAGED", 2)
    many = {r.doc_id: r.score for r in L.lm_scores(docs).collect()}
    assert sum(many.values()) == pytest.approx(sum(one.values()), rel=0.1)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b a"), (3, "A b a"), (None, "a zz"), (7, "x " * 30_000), (4, "a b c")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = L.lm_scores(df).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert L.lm_scores(df.limit(0)).count() == 0
    assert L.lm_scores(df.where("doc_id is null")).first().train_tokens == 0


def test_every_training_token_is_learnt(spark, monkeypatch):
    """the turns of the pass over all chunks take each training token once, also those that the start doesn't read."""
    monkeypatch.setattr(L, "TRAIN_TOKENS", 1000)  # the start reads a few documents only
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = docs.select(L.F.col("doc_id").alias("id"), "text", L.held_out("doc_id").alias("held_out"), L.in_training("doc_id").alias("learn"))
    blocks = L.settle(L._blocks(source.repartition(5)), "test-blocks")
    counts = L._counts(blocks)
    words = counts.where("word is not null").select("word", "c")
    n = sum(len(L.tokens_of(r.text)) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1)
    classes, frequent = L._classes(words)
    model = L._start(source, classes, frequent, n)
    found = [r for turn in range(len(L.PASSES)) for r in L._learned(blocks, model, classes, turn).collect()]
    assert sum(r.n for r in found) == n and len(found) > 1
    whole = L._train(source, blocks, classes, frequent, n)
    texts = [L.tokens_of(r.text) for r in docs.where(L.held_out("doc_id")).collect()]
    x, c, m = classes.place([w for t in texts for w in t])
    score = lambda g: g.score(x, c, np.maximum(m, 0), np.array([len(t) for t in texts]), classes.frequent[L.END]).astype(float).sum()
    assert score(whole) > 0.99 * score(model)


def test_lanes_start_texts_afresh():
    """Gradients of texts laid end to end in a lane are the sum of each text's own."""
    rng = np.random.default_rng(5)
    model = gru.Gru.fresh(9, np.zeros(4), np.zeros((2, 3)), seed=2)
    x, c, m = (rng.integers(0, k, (7, 1)) for k in (9, 4, 3))
    live, keep, h = np.ones((7, 1), bool), np.ones((7, 1), np.float32), np.zeros((1, gru.HIDDEN), np.float32)
    keep[[0, 4]] = 0
    both, _ = gru._gradients(model, x, c, m, live, h + 0.5, keep)
    parts = [gru._gradients(model, x[s], c[s], m[s], live[s], h)[0] for s in (slice(0, 4), slice(4, 7))]
    for a, p, q in zip(both, *parts, strict=True):
        assert np.allclose(a, p + q, atol=1e-5)
    adam, before = gru.Adam(model), [a.copy() for a in model.arrays()]
    gru.learn(adam, x.ravel(), c.ravel(), m.ravel(), np.array([4, 0, 3]), 0, 0.01, lanes=2, window=2)
    assert adam.turn == 2 and all((a != b).any() for a, b in zip(model.arrays(), before, strict=True))
