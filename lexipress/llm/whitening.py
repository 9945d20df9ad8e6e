"""Whitening of embeddings: blockwise QR of centred rows, and the bidiagonal solver of ``qd`` on R."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexipress.llm import qd
from lexipress.llm._arrow import column
from lexipress.llm.topk import quantised
from lexipress.storage import settle

#: Rows of a QR block, triangles that one task merges, and a singular value beside the largest that counts as none.
BLOCK_ROWS, MERGE, NEGLIGIBLE = 4_096, 16, 1e-12


def _matrix(rows: pa.Array, width: int, rest: int) -> np.ndarray:
    """A list column as a matrix; rows that are shorter end in ``rest``."""
    flat, size = rows.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(rows).to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(rows), width)
    out = np.full((len(rows), width), rest, flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _summed(df: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray], size: int, kind: str) -> np.ndarray:
    """``size`` sums over all rows: each task adds up its batches', then cell by cell; ``size`` numbers in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            if batch.num_rows:
                total += sums(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "v"])

    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in df.mapInArrow(run, f"cell long, v {kind}").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r.cell] = r.v
    return out


def triangle(rows: DataFrame, centred: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """R of the centred rows' QR factorisation: tasks factor block after block, then MERGE triangles at a time until
    a task is enough for those left. A triangle is width x width, whatever the number of rows."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = (centred(batch) for batch in batches if batch.num_rows)
        r = qd.blockwise_r((x[k : k + BLOCK_ROWS] for x in matrices for k in range(0, len(x), BLOCK_ROWS)), width)
        if r.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def merge(some: pd.DataFrame) -> pd.DataFrame:
        r = qd.blockwise_r((np.reshape(x, (width, width)) for x in some.sort_values("part")["r"]), width)
        return pd.DataFrame({"part": [int(some["part"].min()) // MERGE], "r": [r.ravel()]})

    parts = settle(rows.mapInArrow(factor, "part long, r array<double>"), "triangles")
    while parts.count() > MERGE:
        parts = settle(parts.groupBy(F.floor(F.col("part") / MERGE)).applyInPandas(merge, "part long, r array<double>"), "triangles")
    return qd.blockwise_r((np.reshape(x.r, (width, width)) for x in parts.orderBy("part").collect()), width)  # MERGE at most


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component int from 1, n, deviation, whitened, explained, identity_error): the principal components of all
    vectors, whitened to variance one, a row per vector and component.

    Entries count as floor(scale * x) + offset. ``deviation`` is exact: the sum over dimensions of (n * x - sum of x) squared,
    null where it exceeds a long. ``whitened`` is the centred vector's projection on the component over the component's
    standard deviation; ``explained`` the component's share of all variance; ``identity_error`` the largest entry of
    the whitened values' covariance less the identity. Means, products and the solver's R come from all rows, centred
    before they are multiplied.

    Rows whose vector is null or has a null or non-finite entry are dropped; null and repeated ids and repeated vectors
    count as rows each. Shorter vectors count as having zeros behind. Components are as many as dimensions at most.
    Where a component has no variance (a standard deviation of NEGLIGIBLE of the largest, or less) ``whitened`` is null and
    takes no part in ``identity_error``; without any variance ``explained`` is null too. Other columns are ignored; an
    empty table gives an empty table.
    """
    spark = vectors.sparkSession
    code = F.transform(quantised(F.col(vector_col), scale), lambda x: x + F.lit(offset))
    rows = settle(vectors.select(F.col(id_col).cast("long").alias("id"), code.alias("x")).where("x is not null"), "to-whiten")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    columns = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not size.n or not size.width:
        return spark.createDataFrame([], columns)
    n, width = size.n, size.width
    entries = lambda batch: _matrix(column(batch, "x"), width, offset)
    sums = _summed(rows.select("x"), lambda batch: entries(batch).sum(axis=0), width, "long")
    centred = lambda batch: (n * entries(batch) - sums) / n
    squares, axes = qd.right_singular(triangle(rows.select("x"), centred, width), components)
    live = np.sqrt(squares[: axes.shape[1]]) > NEGLIGIBLE * np.sqrt(squares[0])
    to_white = axes / np.sqrt(np.where(live, squares[: axes.shape[1]], 1.0) / n)
    explained = [float(x) for x in squares[: axes.shape[1]] / squares.sum()] if squares[0] > 0 else [None] * axes.shape[1]
    k = axes.shape[1]

    def deviations(d: np.ndarray) -> list:
        if float(np.abs(d).max()) ** 2 * width < 2**63 - 1:
            return np.einsum("ij,ij->i", d, d).tolist()
        exact = (d.astype(object) ** 2).sum(axis=1).tolist()
        return [x if x < 2**63 else None for x in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = n * entries(batch) - sums
                w = (d / n) @ to_white
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(deviations(d), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    white = settle(rows.mapInArrow(project, "id long, deviation long, w array<double>"), "whitened")
    values = lambda batch: _matrix(column(batch, "w"), k, 0)
    mean = _summed(white.select("w"), lambda batch: values(batch).sum(axis=0), k, "double") / n

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = values(batch) - mean
        return (w.T @ w).ravel()

    covariance = _summed(white.select("w"), moments, k * k, "double").reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k))[np.ix_(live, live)].max()) if live.any() else None
    each = white.select("id", "deviation", F.posexplode("w").alias("at", "value"))
    of_component = lambda some, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in some]), F.col("at") + 1)
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(of_component(live.tolist(), "boolean"), F.col("value")).alias("whitened"), of_component(explained, "double").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
