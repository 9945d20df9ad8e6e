import itertools
import random
import zlib

import numpy as np
import pytest

from lexipress.llm import language as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in L.language_of(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(out) == len(rows)
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if out[r.doc_id].held_out]
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in held]) >= 0.98


def test_viterbi_is_best():
    rng = np.random.default_rng(2)
    lengths = np.array([4, 0, 6, 1, 5])
    scores = -rng.random((lengths.sum(), 3)).astype(np.float32) * 5
    got, end = L.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        part = scores[end : end + n]
        cost = lambda path: sum(part[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        if n:
            assert cost(got[end : end + n]) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=int(n)))), abs=1e-4)
        end += n


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    stems = {"aa": ["the", "thing", "whith", "shen", "ough"], "bb": ["der", "schön", "über", "nicht", "keit"], "cc": ["это", "слово", "язык", "который"]}
    rows = [(3 * i + k, " ".join(rng.choice(w) for _ in range(40)), lang) for i in range(60) for k, (lang, w) in enumerate(stems.items())]
    df = spark.createDataFrame([*rows, (9001, None, "aa"), (9002, "x", None)], "doc_id long, text string, lang string")
    return L.fit(df), stems, df


def test_spans_of_mixed_text(spark, model):
    m, stems, _ = model
    text = " ".join(stems["aa"] * 4 + stems["bb"] * 4 + stems["cc"] * 4)
    lang, share, spans = L.Labeller(m).label([text])[0]
    assert [(s[2], s[1]) for s in spans] == [("aa", 20), ("bb", 20), ("cc", 16)] and lang in stems and 0 < share < 1


def test_rows(spark, model):
    m, stems, df = model
    rows = [(1, None), (2, ""), (3, "123 -- 45"), (4, "schön über"), (5, "слово " * 60_000), (4, "schön über"), (None, "the thing"), (6, "日本語")]
    out = L.identify(spark.createDataFrame([(i, t, "zz", 1) for i, t in rows], "doc_id long, text string, lang string, score int"), m).collect()
    got = sorted((r.doc_id or 0, r.lang_pred) for r in out)
    assert got[:-1] == [(0, "aa"), (1, "und"), (2, "und"), (3, "und"), (4, "bb"), (4, "bb"), (5, "cc")] and got[-1][1] in stems
    assert all(0 <= r.score <= 1 for r in out)
    assert L.language_of(df.limit(0)).count() == 0
    none = L.language_of(df.where("lang is null")).collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_memory_of_words_starts_afresh(model, monkeypatch):
    m, stems, _ = model
    lab = L.Labeller(m)
    first = lab.label(["the thing", "слово"])
    lab._forget()
    assert lab.label(["the thing", "слово"]) == first


def test_scripts_bar_languages(spark):
    """A learned language that a word's script bars never gets it, however few or long the words are."""
    rng = random.Random(3)
    words = {"en": ["the", "thing", "with", "shown"], "ru": ["это", "слово", "язык", "который"]}
    han = [chr(c) for c in range(0x4E00, 0x4E40)]
    rows = [(3 * i + k, " ".join(rng.choice(w) for _ in range(40)), lang) for i in range(60) for k, (lang, w) in enumerate(words.items())]
    rows += [(3 * i + 2, "".join(rng.choices(han, k=80)), "zh") for i in range(60)]
    lab = L.Labeller(L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    lang, share, spans = lab.label(["the thing " + "".join(rng.choices(han, k=500))])[0]
    assert lang == "zh" and share == 500 / 508 and spans == [(0, 2, "en"), (2, 1, "zh")]
    assert lab.label(["the thing слово with shown"])[0][2] == [(0, 2, "en"), (2, 1, "ru"), (3, 2, "en")]
    lang, share, spans = lab.label(["thing" + "".join(han[:20]) + "слово the"])[0]
    assert lang == "zh" and share == 20 / 33 and spans == [(0, 1, "zh"), (1, 1, "en")]
    assert L.pieces_of("über-größe") == ("über-größe",) and "".join(L.pieces_of("«язык»abc1日本語の文字x")) == "«язык»abc1日本語の文字x"
    assert L.pieces_of("«язык»abc1日本語の文字x") == ("«язык»", "abc1", "日本語の", "文字", "x")
