import random

import numpy as np
import pytest

from lexipress.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_votes_find_accuracies():
    """Counted patterns drawn from known accuracies give them back."""
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.5
    real = np.array([0.9, 0.8, 0.95, 0.7, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9, 0.8])
    side = np.where(rng.random((20_000, Q.N_LABELLERS)) < real, truth[:, None], ~truth[:, None])
    cast = rng.random((20_000, Q.N_LABELLERS)) < 0.6
    patterns, counts = np.unique(["".join("-" if not c else "g" if s else "b" for s, c in zip(a, b, strict=True)) for a, b in zip(side, cast, strict=True)], return_counts=True)
    model = Q.fit_labels(patterns.tolist(), counts.astype(float))
    assert np.abs(model.accuracy - real).max() < 0.03


def test_against_labels(spark):
    """Labels are never used to fit; they measure the result."""
    out = Q.classify(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in out if r.quality], [r for r in out if not r.quality]
    assert np.mean([r.accepted for r in good]) >= 0.99 and np.mean([not r.accepted for r in bad]) >= 0.97


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9)))
    out = []
    for i in range(120):
        w = [word() for _ in range(60)]
        out.append((i, "\n".join(" ".join(w[k : k + 10]).capitalize() + "." for k in range(0, 60, 10)) if i % 2 else " ".join(x.upper() + "!!" for x in w)))
    return [*out, (500, None), (501, ""), (502, "  \n "), (503, "word " * 100_000), (1, out[1][1]), (None, out[3][1])]


def test_rows(spark, rows):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    out = Q.classify(df).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "score", "weak_label", "accepted"}
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].accepted for i in (500, 501, 502, 503)] == [False] * 4 and by[500][0].score < 1e-6
    assert all(by[i][0].accepted == bool(i % 2) for i in range(120))
    assert by[1][0].score == by[1][1].score and by[None][0].score == by[3][0].score
    assert Q.classify(df.limit(0)).count() == 0
