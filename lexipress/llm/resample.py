"""Resampling towards a target distribution: hashed n-gram gains, perturbed weights, and exact ranks by regular sampling."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column
from lexipress.storage import settle

#: Rows of a segment (about) while segments are fewer than MOST_SEGMENTS; samples of a segment.
SEGMENT_ROWS, MOST_SEGMENTS, SAMPLES = 8_192, 20_000, 16
CHUNK = 4 << 20

#: Lower-cases A-Z and makes every ASCII character that is neither letter nor digit a space; other bytes stay.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of digits, letters a-z (A-Z in lower case) and all that isn't ASCII."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def buckets_of(some: list[bytes], lo: int, hi: int, buckets: int) -> np.ndarray:
    """The bucket of each run of ``lo`` to ``hi`` consecutive words, repeats included."""
    parts = [some if k == 1 else [b" ".join(some[i : i + k]) for i in range(len(some) - k + 1)] for k in range(lo, hi + 1)]
    found = [np.fromiter(map(zlib.crc32, p), np.uint32, len(p)) for p in parts]
    return (np.concatenate(found) if found else np.zeros(0, np.uint32)) % np.uint32(buckets)


def features(docs: DataFrame, lo: int, hi: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, cells): the buckets of all features of each text as packed unsigned integers, two bytes each if
    they fit; a fraction of the text, which is not read again."""
    width = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            n, cells = [], []
            for text in column(batch, "text").to_pylist():
                w = words(text)
                n.append(len(w))
                cells.append(buckets_of(w, lo, hi, buckets).astype(width).tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(n, pa.int64()), pa.array(cells, pa.binary())], names=["id", "n_words", "cells"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, cells binary")


def _packed(cells: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a column and where each row's begin and end."""
    width = 2 if buckets <= 1 << 16 else 4
    at = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, 4 * cells.offset)
    data = cells.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(f"<u{width}") if data is not None and at[-1] > at[0] else np.zeros(0, "<u2")
    return flat, (at - at[0]) // width


def bucket_totals(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: each task adds up its own, then bucket by bucket; ``buckets`` numbers in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(_packed(batch.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in table.select("cells").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of each of B buckets."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 * a Gumbel value) of a document, by its id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _keys(score: np.ndarray, null: np.ndarray, ids: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Byte strings whose order is that of the draw: higher scores first, then smaller ids, null ids last, then ``tie``."""
    out = np.zeros(len(score), np.dtype([("s", ">u8"), ("n", "u1"), ("i", ">u8"), ("t", ">u8")]))
    flip = np.uint64(1 << 63)
    out["s"], out["n"], out["i"], out["t"] = ~(score.view(np.uint64) ^ flip), null, ids.view(np.uint64) ^ flip, tie.view(np.uint64)
    return out.view(f"S{out.dtype.itemsize}")


def drawn_ranks(scored: DataFrame, percent: int) -> DataFrame:
    """Adds ``rank`` (from 1) to the best ``floor(percent * N / 100)`` of the N rows that may be drawn, null for all others.

    scored: (id, score, may boolean, ...). Sorting by regular sampling: rows lie in locally sorted runs, with their places
    in them; every so-manyth row of each run is a sample, and every SAMPLES-th sample of all a splitter. Rows of a segment
    between two splitters go to one task, which merges what runs have of it; ranks are places there plus the rows of all
    segments before. Only segments that the draw reaches are exchanged. A row's run and place end all ties, so no score, id
    or group of repeated rows can fill a segment.
    """
    order = [F.col("may").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()]
    runs = settle(scored.sortWithinPartitions(*order).withColumn("tie", F.monotonically_increasing_id()), "sorted-runs")
    n = runs.where("may").count()
    draw = percent * n // 100
    columns = [c for c in runs.columns if c != "tie"]
    if not draw:
        return runs.select(*columns, F.lit(None).cast("long").alias("rank"))
    cores = runs.sparkSession.sparkContext.defaultParallelism
    segments = max(1, min(MOST_SEGMENTS, max(n // SEGMENT_ROWS, min(cores, n // 1024))))
    step = max(1, n // (SAMPLES * segments))
    place = F.col("tie").bitwiseAND(F.lit((1 << 33) - 1))
    picked = runs.where(F.col("may") & (place % step == step // 2)).select("score", "id", "tie").collect() if segments > 1 else []  # about SAMPLES * segments
    numpy = lambda values: np.array([v or 0 for v in values], np.int64)
    samples = np.sort(_keys(numpy(r.score for r in picked), np.array([r["id"] is None for r in picked], np.uint8), numpy(r["id"] for r in picked), numpy(r.tie for r in picked)))
    splitters = samples[[len(samples) * k // segments for k in range(1, segments)]] if len(samples) else samples

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "id")
            full = lambda name: column(batch, name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            keys = _keys(full("score"), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False), full("tie"))
            at = np.searchsorted(splitters, keys, side="right")
            at = np.where(full("may"), at, segments).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "segment"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    placed = runs.mapInArrow(place_rows, f"{types}, segment int")
    sizes = {r.segment: r["count"] for r in placed.where("may").groupBy("segment").count().collect()}  # at most MOST_SEGMENTS rows
    before, reached, at = [], 0, 0
    for s in range(segments):
        before.append(at)
        reached += at < draw
        at += sizes.get(s, 0)
    taken = placed.where(F.col("segment") < reached).repartitionById(reached, "segment")
    inner = F.row_number().over(Window.partitionBy("segment").orderBy(*order, "tie")).cast("long")
    rank = inner + F.element_at(F.lit(np.array(before[:reached], np.int64)), F.col("segment") + 1)
    ranked = taken.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = placed.where(F.col("segment") >= reached).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, lo: int = 1, hi: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank), a row per row of ``docs``: which documents to draw so that hashed features are
    distributed as in ``target``.

    Features are runs of ``lo`` to ``hi`` words, hashed into ``buckets``; a bucket's gain compares its share in ``target``
    with that in all of ``docs``; ``weight`` is the floored mean of a document's gains and ``score`` adds a Gumbel value of
    its id, so that the highest scores are a draw without replacement. ``rank`` is 1, 2, ... for what is drawn: ``percent``
    % of the documents with ``least_words`` words, ties to the smaller id; null for others.

    Null and empty texts have no features and weight 0. Rows with a null id share one Gumbel value and come last in ties;
    rows with the same id are ranked each. Very long texts count whole, other columns are ignored, an empty ``docs`` gives an
    empty table and an empty ``target`` no features.
    """
    table = settle(features(docs, lo, hi, buckets, id_col, text_col), "hashed-features")
    wanted = features(target.withColumn("__none", F.lit(None).cast("long")), lo, hi, buckets, "__none", target_col)
    gains = bucket_gains(bucket_totals(table, buckets), bucket_totals(wanted, buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _packed(column(batch, "cells"), buckets)
            n = np.diff(at).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(gains[flat])))
            weight = np.where(n > 0, (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1), 0)
            ids = column(batch, "id")
            extra = np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            may = pa.compute.greater_equal(column(batch, "n_words"), least_words)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(weight + extra), may], names=["id", "n_features", "weight", "score", "may"])

    scored = table.mapInArrow(score, "id long, n_features long, weight long, score long, may boolean")
    return drawn_ranks(scored, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


SQL = """
with cells as (
  select n::bigint as cell, list_reduce(range(8), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n::bigint) as v from range(256) r(n)
),
crc_table as (select list(v order by cell) as crc from cells),
texts as (
  select 0 as side, row_number() over () as row, doc_id, text from documents union all select 1, row_number() over (), null, text from benchmark
),
found as (
  select side, row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts
),
each as (select side, row, unnest(w) as word from found),
distinct_words as (select word, hex(encode(word)) as h from each group by word),
hashed as (
  select word,
    (xor(list_reduce(list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::bigint),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 10000)::int as bucket
  from distinct_words, crc_table
),
counted as (
  select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from each join hashed using (word) group by bucket
),
gains as (
  select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + 10000))::double / ((s + 1) * (sum(t) over () + 10000))::double))::bigint as gain from counted
),
weights as (
  select row, floor(sum(gain)::double / count(*))::bigint as weight from each join hashed using (word) join gains using (bucket) where side = 0 group by row
),
scored as (
  select doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from found left join weights using (row) where side = 0
),
ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as r, count(*) filter (n_features >= 20) over () as n from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and r <= floor(10 * n / 100) then r end::bigint as rank from ranked
"""
