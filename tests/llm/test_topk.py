import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexipress.llm import topk as T


def plain(rows, queries, k=5):
    q = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in queries}
    out = []
    for i, v in q.items():
        found = sorted((-int(v @ np.floor(256 * np.array(w)).astype(np.int64)), j) for j, w in rows if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [(8, 40, 16), (256, 32_768, 8_192)])
def test_rows(spark, monkeypatch, size):
    monkeypatch.setattr(T, "BLOCK", size[0])
    monkeypatch.setattr(T, "RANGE_ROWS", size[1])
    monkeypatch.setattr(T, "QUERY_ROWS", size[2])
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    good += [(1000 + i, good[7][1]) for i in range(30)]  # ties
    bad = [(2000, None), (2001, [1.0] * 7 + [None]), (2050, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7), (None, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<float>, rank int")
    queries = df.where("vec_id % 50 = 0")
    got = sorted(map(tuple, T.top_k(df, queries).collect()))
    assert got == plain(good, [r for r in good if r[0] % 50 == 0])
    assert T.top_k(df.limit(0), queries).count() == 0 and T.top_k(df, queries.limit(0)).count() == 0
    assert sorted(map(tuple, T.top_k(df.where("vec_id in (0, 1)"), queries.where("vec_id = 0")).collect())) == plain(good[:2], good[:1])


def test_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, T.top_k(df, df.where("vec_id = 0")).collect())) == [(0, 1, 1, 131072), (0, 2, 1, 131072)]


def test_large_values_stay_exact():
    a, b = np.array([[2**30, 1]]), np.array([[2**31, 1], [2**31, 2]])
    assert T._exact(a, b).tolist() == [[2**61 + 1, 2**61 + 2]]


def test_oracle(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{d}'")
    df = spark.read.parquet(d)
    got = T.top_k(df, df.where(F.col("vec_id") % 50 == 0))
    assert sorted(con.sql(T.SQL).fetchall()) == sorted(map(tuple, got.collect()))


def test_blocks_are_left_out():
    """Where vectors lie in clusters under half of the pairs of a query and a block are scored, with the same result."""
    rng = np.random.default_rng(6)
    spots = rng.normal(0, 1, (40, 32))
    x = np.floor(256 * (spots[rng.integers(0, 40, 8000)] + rng.normal(0, 0.15, (8000, 32)))).astype(np.int64)
    cell = T.nearest(x, T.centres(x[:2000], 40))
    order = np.argsort(cell, kind="stable")
    ids, seen = np.arange(8000), []
    got = T.block_search(ids[:200], x[:200], ids[order], x[order], 5, seen=seen)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = T.NOTHING
    want = [(q, v, int(s[q, v])) for q in range(200) for v in sorted(range(8000), key=lambda v: (-s[q, v], v))[:5]]
    assert got == want and seen[0][1] < seen[0][0] / 2


@pytest.mark.parametrize("bound_bytes", [64 << 20, 0])
def test_many_ranges(spark, monkeypatch, bound_bytes):
    monkeypatch.setattr(T, "RANGE_ROWS", 150)
    monkeypatch.setattr(T, "QUERY_ROWS", 30)
    monkeypatch.setattr(T, "BOUND_BYTES", bound_bytes)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 1, (10, 6))[rng.integers(0, 10, 700)] + rng.normal(0, 0.2, (700, 6)), 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(np.int64)
    s = q @ q.T
    want = sorted((i, r + 1, v, int(s[i, v])) for i in range(0, 700, 7) for r, v in enumerate(sorted((v for v in range(700) if v != i), key=lambda v: (-s[i, v], v))[:5]))
    assert sorted(map(tuple, T.top_k(df, df.where("vec_id % 7 = 0")).collect())) == want
