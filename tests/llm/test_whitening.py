import numpy as np
import pytest
from pyspark.sql import functions as F

from lexipress.llm import qd, whitening
from lexipress.llm.queries import op12_embedding_whitening

SF = "/root/testdata/sf0.001"


def matrices():
    rng = np.random.default_rng(2)
    turn = lambda k: np.linalg.qr(rng.standard_normal((k, k)))[0]
    yield rng.standard_normal((500, 24))
    yield rng.standard_normal((300, 20)) * np.logspace(0, -7, 20)
    yield np.vstack([np.eye(9)] * 3)
    yield np.zeros((5, 4))
    yield np.ones((9, 6))
    yield rng.standard_normal((3, 8))
    yield (turn(30) * np.repeat([3.0, 2.0, 1.0], [5, 5, 20])) @ turn(30)
    yield rng.integers(-3, 4, (7, 3)).astype(float)
    yield rng.standard_normal((50, 1))


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: str(a.shape))
def test_solver(a):
    r = qd.blockwise_r(np.array_split(a, 3), a.shape[1])
    squares, v = qd.right_singular(r, 8)
    known = np.zeros(a.shape[1])
    known[: min(a.shape)] = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(known[0], 1e-300)
    assert np.abs(squares - known).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
    assert np.abs(a.T @ a @ v - v * squares[: v.shape[1]]).max() <= 1e-12 * top


def test_bidiagonal_and_small_values():
    a, b = np.logspace(0, -12, 13), np.logspace(-1, -13, 12)[:12]
    got = qd.squared_singular_values(a, b)
    product = np.prod(a**2)  # the determinant is known to full relative accuracy
    assert abs(np.prod(got) / product - 1) < 1e-12
    m = np.random.default_rng(3).standard_normal((11, 11))
    d, e, v = qd.bidiagonal(np.triu(m))
    mid = np.diag(d) + np.diag(e, 1)
    assert np.abs(v @ (mid.T @ mid) @ v.T - np.triu(m).T @ np.triu(m)).max() < 1e-12


def plain(rows, components=8, scale=1024, offset=100_000):
    """By numpy's own eigenvectors, with deviations in Python's integers."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    x = [[int(np.floor(scale * float(c))) + offset for c in v] + [offset] * (width - len(v)) for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    y = np.array(x, np.float64) - np.array(sums) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in good], deviation, y @ v[:, :components] / np.sqrt(np.abs(e[:components]) + 1e-300), e / e.sum()


def compare(out, rows, components=8):
    ids, deviation, white, explained = plain(rows, components)
    got = sorted(map(tuple, out.collect()), key=lambda r: (r[1], r[0], r[3]))
    assert len(got) == white.shape[1] * len(ids)
    for k in range(white.shape[1]):
        part = got[k * len(ids) : (k + 1) * len(ids)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], deviation[i]))
        assert [(r[0], r[1], r[2], r[3]) for r in part] == [(ids[i], k + 1, len(ids), deviation[i]) for i in order]
        w, mine = white[order, k], np.array([r[4] for r in part])
        assert min(np.abs(w - mine).max(), np.abs(w + mine).max()) < 1e-8
        assert all(abs(r[5] / explained[k] - 1) < 1e-10 and r[6] < 1e-9 for r in part)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(op12_embedding_whitening(spark, SF), rows)


def test_odd_rows(spark, monkeypatch):
    """Nulls, non-finite entries, short vectors, a vector that a third of the rows have, repeated ids, many triangles."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "MERGE", 3)
    rng = np.random.default_rng(4)
    rows = [(i % 300, rng.standard_normal(12).tolist()) for i in range(400)] + [(1000, [0.5] * 12)] * 200 + [(7, [1.0, 2.0])]
    bad = [(5, None), (6, [None] * 12), (8, [float("nan")] * 12), (9, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("w", F.lit(1)).withColumn("id", F.lit("x")).repartition(13)
    compare(whitening.whiten(df), rows)
    compare(whitening.whiten(df, components=3), rows, 3)


def test_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert len(same) == 4 and all((r.deviation, r.whitened, r.explained, r.identity_error, r.n) == (0, None, None, None, 2) for r in same)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 3.0]) for i in range(10)], kind)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and abs(flat[0].identity_error) < 1e-12


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(i) * 1e6, 0.0]) for i in range(60)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()}
    want = dict(zip(*plain(rows)[:2], strict=True))
    assert got == {i: d if d < 2**63 else None for i, d in want.items()} and None in got.values()
