"""Exact top-k inner products with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexipress.storage import settle

#: Below any score; its negative is a 64-bit integer too.
NOTHING = -(1 << 63) + 1
#: Vectors of a block, vectors of a range (what a task holds at once), queries of a batch, and a query's blocks that come
#: in its own order.
BLOCK, RANGE_ROWS, QUERY_ROWS, FIRST = 128, 32_768, 8_192, 6
#: Vectors that cells are fitted on (about), cells at most, and bytes of range bounds that go to tasks at most.
SAMPLE_ROWS, MOST_CELLS, BOUND_BYTES = 8_192, 512, 64 << 20


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, in double precision; null if the vector is null or has a null or a
    component that isn't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: in floating point where every sum is below 2**53, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """Each query's k best so far, best first, ties to the smaller id."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.score = np.full((len(q_ids), k), NOTHING)
        self.vector = np.full((len(q_ids), k), np.iinfo(np.int64).max)

    def add(self, want: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores of vectors ``ids`` for queries ``want``; a query's own id doesn't count."""
        own = ids[None, :] == self.q_ids[want][:, None]
        s = np.where(own, NOTHING, s)
        v = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, s.shape))
        every_s, every_v = np.concatenate((self.score[want], s), axis=1), np.concatenate((self.vector[want], v), axis=1)
        if every_s.shape[1] > 4 * self.k:  # those below the k-th best score can't stay
            kth = -np.partition(-every_s, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            some = every_s >= kth
            width = int(some.sum(axis=1).max())
            at = np.argsort(~some, axis=1, kind="stable")[:, :width]
            every_s, every_v = np.take_along_axis(every_s, at, 1), np.take_along_axis(every_v, at, 1)
        order = np.lexsort((every_v, -every_s), axis=1)[:, : self.k]
        self.score[want], self.vector[want] = np.take_along_axis(every_s, order, 1), np.take_along_axis(every_v, order, 1)


def term_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No vector between ``low`` and ``high`` scores more: the sum over dimensions of the larger of the two products."""
    return _exact(np.maximum(queries, 0), high) + _exact(np.minimum(queries, 0), low)


def block_search(q_ids: np.ndarray, queries: np.ndarray, v_ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK, least: np.ndarray | None = None, seen: list | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score): each query's k best of ``vectors`` but itself (rows with its id), ties to the smaller
    id; fewer if there are fewer, or if what is left out scores below ``least``, a score that the query has k times already.

    Vectors lie in blocks of neighbours. A block's terms are its largest and smallest value in each dimension; a query's
    bound for a block is their sum (``term_bounds``). Each query takes its blocks in the order of its own bounds, the
    first FIRST of them one by one; then blocks come one by one for all queries whose k-th best so far their bounds
    still reach. A block is scored through its forward index, its rows, and a query is done when its bounds fall below
    its k-th best. ``seen`` gets how many pairs of a query and a block there are, and how many were scored.
    """
    n = len(v_ids)
    if not n or not len(q_ids):
        return []
    starts = np.arange(0, n, block)
    bounds = term_bounds(queries, np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0))
    best, scored = Best(q_ids, k), 0
    least = np.full(len(q_ids), NOTHING) if least is None else least
    reach = lambda some: np.maximum(best.score[some, k - 1], least[some])

    def score(b: int, want: np.ndarray) -> int:
        rows = slice(starts[b], starts[b] + block)
        best.add(want, v_ids[rows], _exact(queries[want], vectors[rows]))
        return len(want)

    order = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
    active = np.arange(len(q_ids))
    for turn in range(order.shape[1]):
        b = order[active, turn]
        ok = bounds[active, b] >= reach(active)
        active, b = active[ok], b[ok]
        for x in np.unique(b).tolist():
            scored += score(x, active[b == x])
    np.put_along_axis(bounds, order, NOTHING, axis=1)
    for x in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
        want = active[(bounds[active, x] >= reach(active)) & (bounds[active, x] > NOTHING)]
        if len(want):
            scored += score(x, want)
    if seen is not None:
        seen.append((bounds.size, scored))
    return [(q, v, s) for q, vs, ss in zip(q_ids.tolist(), best.vector.tolist(), best.score.tolist(), strict=True) for v, s in zip(vs, ss, strict=True) if s > NOTHING]


def centres(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Centres of cells of neighbours: k-means over a sample. They only order the vectors; results don't depend on them."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:cells]].astype(np.float64)
    for _ in range(rounds):
        at = nearest(sample, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): of each row of ``queries`` the k rows of ``vectors`` with the highest
    integer inner product, its own id aside; all, if there are fewer. Ties go to the smaller id.

    Components count as floor(scale * x). Rows with a null id, a null vector, or null or non-finite components take no
    part; vectors shorter than the longest count as having zeros behind. Repeated rows of an id are candidates each;
    repeated queries count once per different vector. Either table empty: no rows.

    Vectors lie in ranges of neighbours: by cells, whose centres are fitted on at most about SAMPLE_ROWS of them. A query
    first searches the range of its highest bound; then it goes only to ranges whose bounds reach its k-th best score.
    Range bounds (two values a dimension) go to tasks while they take BOUND_BYTES at most; beyond that, queries go to
    all ranges. Neither ranges nor batches of queries grow with the data.
    """
    spark = vectors.sparkSession
    code = quantised(F.col(vector_col), scale)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), code.alias("v")).where("id is not null and v is not null")
    rows, wanted = settle(pick(vectors), "vectors"), settle(pick(queries).distinct(), "queries")
    size, m = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first(), wanted.count()
    if not size.n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(size.width, wanted.agg(F.max(F.size("v"))).first()[0])
    n_ranges, batches = -(-size.n // RANGE_ROWS), -(-m // QUERY_ROWS)
    share = int((1 << 40) * min(1.0, SAMPLE_ROWS / size.n)) + 1
    sample = _matrix([r.v for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share).orderBy(F.xxhash64("id", "v")).limit(2 * SAMPLE_ROWS).select("v").collect()], width)
    cells = centres(sample, max(1, min(MOST_CELLS, size.n // BLOCK, len(sample))))

    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(_matrix(v, width), cells), dtype="int32")

    celled = rows.withColumn("cell", F.pandas_udf(cell_of, "int")("v"))
    dealt = celled.repartitionByRange(n_ranges, "cell", "id") if n_ranges > 1 else celled.coalesce(1)
    dealt = settle(dealt.select("id", "v", "cell", F.spark_partition_id().alias("range")), "vector-ranges")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r, some in frame.groupby("range"):
                x = _matrix(some["v"], width)
                yield pd.DataFrame({"range": [r], "high": [x.max(axis=0)], "low": [x.min(axis=0)]})

    parts = dealt.select("range", "v").mapInPandas(ends, "range int, high array<long>, low array<long>")
    terms = parts.groupBy("range").agg(*[F.array(*[F.expr(f"{f}({c}[{i}])") for i in range(width)]).alias(c) for f, c in (("max", "high"), ("min", "low"))])
    names, high, low = np.arange(0), np.zeros((0, width), np.int64), np.zeros((0, width), np.int64)
    if n_ranges * width * 16 <= BOUND_BYTES:
        found = terms.orderBy("range").collect()
        names, high, low = np.array([r["range"] for r in found]), _matrix([r.high for r in found], width), _matrix([r.low for r in found], width)
    sent = spark.sparkContext.broadcast((names, high, low))

    def route(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, high, low = sent.value
            for q in batches:
                bounds = term_bounds(_matrix(q["v"], width), high, low)
                home = bounds.argmax(axis=1)
                go = np.zeros(bounds.shape, bool)
                if first:
                    go[np.arange(len(q)), home] = True
                else:
                    go = bounds >= q["least"].to_numpy()[:, None]
                    go[np.arange(len(q)), home] = False
                at, to = np.nonzero(go)
                out = q.iloc[at].copy()
                out["range"] = names[to].astype("int32")
                yield out[["range", "id", "v", "least"]]

        return run

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(a["v"], width), _matrix(b["v"], width)
        order = np.lexsort((b["id"].to_numpy(), y.argmax(axis=1), b["cell"].to_numpy()))
        found = block_search(a["id"].to_numpy(np.int64), x, b["id"].to_numpy(np.int64)[order], y[order], k, least=a["least"].to_numpy(np.int64))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def searched(some: DataFrame) -> DataFrame:
        left = settle(some.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "routed")
        asked = left.select("range", F.col("batch").alias("asked")).distinct()
        right = dealt.join(asked.hint("shuffle_merge"), "range").select(F.col("range").alias("part"), "asked", "id", "v", "cell")
        return settle(left.groupBy("range", "batch").cogroup(right.groupBy("part", "asked")).applyInPandas(search, "query_id long, vec_id long, score long"), "bests")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    routed = "range int, id long, v array<long>, least long"
    fresh = wanted.withColumn("least", F.lit(NOTHING))
    if len(names):
        found = searched(fresh.mapInPandas(route(True), routed))
        kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        later = settle(wanted.join(kth.hint("shuffle_merge"), "id", "left").select("id", "v", F.coalesce("kth", F.lit(NOTHING)).alias("least")), "known-bests")
        found = found.unionByName(searched(later.mapInPandas(route(False), routed)))
    else:
        found = searched(fresh.select(F.explode(F.sequence(F.lit(0), F.lit(n_ranges - 1))).alias("range"), "id", "v", "least"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.e::double[], d.e::double[])::bigint as score
  from v q join v d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
