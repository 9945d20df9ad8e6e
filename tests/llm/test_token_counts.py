import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lexipress.llm import token_counts as T
from lexipress.llm.queries import op13_token_counts

PATH = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def plain(texts, path=PATH):
    """Each whole text by the library, one by one."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def odd_texts():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\0", "a", "Ab", "12", "'s", "'t", "é", "日本", "🙂", "<|endoftext|>", "<|", "!!", " ", " ", "x" * 70, "=" * 90, " the"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return [None, "", " ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", " <|endoftext|>  x", "the end  ", *made, "word " * 200_000, "y" * 30_000, *made[:50]]


def test_odd_texts(spark):
    texts = odd_texts()
    rows = [(None if i % 50 == 3 else i % 40, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "pretoken", "pieces", "known", "id"):
        df = df.withColumn(name, F.lit("x"))
    out = T.token_counts(df, PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, plain(texts), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert T.token_counts(df.limit(0), PATH).count() == 0


def test_joined_pretokens(spark, monkeypatch):
    """The same counts if few or no pre-tokens go to tasks, and if tasks pass on what they gather often."""
    texts = odd_texts()[:200] + ["the same line again and again\n"] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(plain(texts)))
    monkeypatch.setattr(T, "TASK_ENTRIES", 5)
    for most in (0, 10):
        monkeypatch.setattr(T, "FREQUENT", most)
        assert {r.doc_id: r.n_tokens for r in T.token_counts(df, PATH).collect()} == want


def test_each_pretoken_once(spark):
    texts = ["the cat and the dog", "the cat", None, "the <|endoftext|> the"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.pretoken: (r.n, r.pieces) for r in T.pretoken_counts(df, PATH).collect()}
    assert got["the"] == (3, 1) and got[" cat"] == (2, 1) and got[" the"] == (2, 1) and "<|endoftext|>" not in got
    assert len(got) == 6 and got[" "] == (1, 1)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    texts = [t for t in odd_texts()[:60] if "\0" not in (t or "")] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(df, P.path(name)).collect()}
    assert got == dict(enumerate(plain(texts, P.path(name))))


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, plain([r.text for r in rows]), strict=True)}
    assert {r.doc_id: r.n_tokens for r in op13_token_counts(spark, SF).collect()} == want
