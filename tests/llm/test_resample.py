import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lexipress.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, target, percent=10, lo=1, hi=1, buckets=10_000, least=20, seed=2024):
    """Brute force, text by text: [(doc_id, n_features, weight, score, rank)] in the order of rows."""

    def cells(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(lo, hi + 1) for i in range(len(w) - k + 1)]

    have = [cells(t) for _, t in rows]
    s, t = Counter(c for _, x in have for c in x), Counter(c for text in target for c in cells(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (i, _), (n, x) in zip(rows, have, strict=True):
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(best[: percent * len(best) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def made(n, seed=3):
    rng = random.Random(seed)
    pool = ["Alpha", "beta", "GAMMA7", "naïve", "日本語", "x", "42", "the", "of"] + [f"w{i}" for i in range(200)]
    return [(i, rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_brute_force(spark):
    rows = made(900)
    target = [t for _, t in made(40, 9)] + [None, ""]
    want = sorted(plain(rows, target), key=str)
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    for name in ("id", "tie", "may", "segment", "cells"):
        texts = texts.withColumn(name, F.lit(1))
    df = frame(spark, rows).withColumn("rank", F.lit("x")).withColumn("segment", F.lit(2)).repartition(7)
    out = R.resample(df, texts)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 30


def test_runs_of_words_and_wide_buckets(spark):
    rows, target = made(200, 4), [t for _, t in made(20, 5)]
    out = R.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=50, lo=1, hi=3, buckets=70_000, least_words=5, seed=7)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(plain(rows, target, 50, 1, 3, 70_000, 5, 7), key=str)


def test_many_segments_and_ties(spark, monkeypatch):
    """Segments of a few rows; a third of all rows are copies with one id, and null ids tie with each other."""
    monkeypatch.setattr(R, "SEGMENT_ROWS", 20)
    hot = (77, "one two three four five six " * 10)
    rows = made(600) + [hot] * 300 + [(None, "alpha beta " * 15)] * 40 + [(-5, None), (None, None), (2**62, "word " * 300_000)]
    random.Random(1).shuffle(rows)
    target = ["one two three", "alpha"]
    df, texts = frame(spark, rows).repartition(9), spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 10, 60, 100):
        got = sorted(map(tuple, R.resample(df, texts, percent=percent).collect()), key=str)
        assert got == sorted(plain(rows, target, percent), key=str)


def test_empty(spark):
    texts = spark.createDataFrame([("a",)], "text string")
    assert R.resample(frame(spark, []), texts).count() == 0
    rows = made(50)
    assert sorted(map(tuple, R.resample(frame(spark, rows), texts.limit(0)).collect()), key=str) == sorted(plain(rows, []), key=str)
