"""Benchmark decontamination: test items found inside long documents by size-partitioned MinHash containment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column
from lexipress.storage import settle

WIDTH = 5
THRESHOLD = 0.8
#: Items up to this many rows and characters go to every task; beyond either, sketches are joined by a shuffle.
TASK_ITEMS, TASK_CHARS = 20_000, 2_000_000
_WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str], width: int = WIDTH) -> set[tuple[str, ...]]:
    """Distinct runs of ``width`` words; of fewer words, the whole sequence; of none, nothing."""
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def needed(n: int, threshold: float) -> int:
    """How many of n shingles a document must have."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


def sketch_size(sizes: list[int], threshold: float) -> int:
    """MinHash values kept of every item of a size partition. A document with the needed share of an item lacks
    fewer of its shingles than this, so it has one of the kept ones: the search misses nothing."""
    return max(n - needed(n, threshold) + 1 for n in sizes)


def size_class(n: int) -> int:
    """Items of 2^k to 2^(k+1) - 1 shingles share a partition."""
    return n.bit_length() - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` ids; 0 where a run holds an unknown word (id 0)."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h, known = np.full(n, np.uint64(width)), np.ones(n, bool)
    for k in range(width):
        part = ids[k : k + n]
        h = (h ^ part) * _MIX[0]
        h ^= h >> np.uint64(29)
        known &= part > 0
    return np.where(known, _mix(h) | np.uint64(1), np.uint64(0))


@dataclass
class ItemIndex:
    """Items in a task: sketches by size partition, and shingles for the exact check."""

    items: list[tuple]
    threshold: float
    width: int
    vocabulary: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.sets = [shingles_of(words_of(text), self.width) for _, text in self.items]
        for s in self.sets:
            for shingle in s:
                for w in shingle:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if s:
                classes.setdefault(size_class(len(s)), []).append(i)
        found: dict[int, dict[int, list[int]]] = {}  # by shingle length, by hash: the items that keep it
        for members in classes.values():
            keep = sketch_size([len(self.sets[i]) for i in members], self.threshold)
            for i in members:
                ids = [[self.vocabulary[w] for w in shingle] for shingle in self.sets[i]]
                length = len(ids[0])
                h = np.sort(_codes(np.array(ids, np.uint64).ravel(), length)[::length])[:keep]
                for x in h.tolist():
                    found.setdefault(length, {}).setdefault(x, []).append(i)
        self.sketches = {length: (np.array(sorted(by), np.uint64), by) for length, by in found.items()}

    def candidates(self, words: list[str]) -> set[int]:
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        out: set[int] = set()
        for length, (sketch, by) in self.sketches.items():
            codes = _codes(ids, length)
            codes = codes[codes > 0]
            if len(codes):
                hit = codes[sketch[np.minimum(np.searchsorted(sketch, codes), len(sketch) - 1)] == codes]
                out.update(i for x in set(hit.tolist()) for i in by[x])
        return out

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, shared shingles, shingles of the item) of each item that the text contains."""
        words = words_of(text)
        out, by_length = [], {}
        for i in sorted(self.candidates(words)):
            s = self.sets[i]
            length = len(next(iter(s)))
            if length not in by_length:
                by_length[length] = {tuple(words[k : k + length]) for k in range(len(words) - length + 1)}
            shared = len(s & by_length[length])
            if shared >= needed(len(s), self.threshold):
                out.append((self.items[i][0], shared, len(s)))
        return out


_OUT = "id long, item_id long, n_shared long, n_item long, containment double"


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(id, item_id, n_shared, n_item, containment), a row for each document row and item that it contains.

    An item is contained if the document has at least ``threshold`` of its distinct shingles (``width`` words in
    lower case, punctuation aside; items of fewer words are one shingle). Every document of any length is
    searched whole. Items are partitioned by their number of shingles; in each partition the smallest MinHash
    values of an item are kept, as many as make a miss impossible, and documents that have one of them are
    verified on the words themselves. Null and empty texts contain nothing, items without a word are contained
    in nothing; repeated items count once, repeated documents give repeated rows; null ids stay null; other
    columns are ignored. Either table empty: no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item")).where("item is not null").distinct()
    known = settle(known, "items")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("chars")).first()
    if size.n <= TASK_ITEMS and size.chars <= TASK_CHARS:
        found = _in_tasks(source, known, threshold, width)
    else:
        found = _by_join(source, known, threshold, width)
    return found.withColumnRenamed("id", id_col)


def select_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that contain no item; rows with a null id are judged like any
    other, and null texts contain none. Either table empty: ``docs`` as it is."""
    known = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item")).where("item is not null").distinct()
    known = settle(known, "items")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("chars")).first()
    if size.n > TASK_ITEMS or size.chars > TASK_CHARS:
        row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
        found = _by_join(docs.select(row.alias("id"), F.col(text_col).cast("string").alias("text")), known, threshold, width)
        found = settle(found.select(F.col("id").alias("key")).distinct(), "contaminated")
        whole = docs.select(row.alias("key"), F.struct("*").alias("whole"))  # a caller's columns keep their names
        return whole.join(found.hint("shuffle_merge"), "key", "left_anti").select("whole.*")
    sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.item) for r in known.collect()])  # bounded as above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(sent.value, threshold, width)
        for batch in chunks(batches, text_col):
            yield batch.filter(pa.array([not index.matches(t) for t in column(batch, text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _rows(ids: list, hits: list[list[tuple]]) -> pa.RecordBatch:
    flat = [(i, *h, h[1] / h[2]) for i, some in zip(ids, hits, strict=True) for h in some]
    cols = list(zip(*flat, strict=True)) if flat else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "item_id", "n_shared", "n_item", "containment"])


def _in_tasks(source: DataFrame, known: DataFrame, threshold: float, width: int) -> DataFrame:
    items = [(r.item_id, r.item) for r in known.collect()]  # bounded by TASK_ITEMS and TASK_CHARS
    sent = source.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(sent.value, threshold, width)
        for batch in chunks(batches, "text"):
            yield _rows(column(batch, "id").to_pylist(), [index.matches(t) for t in column(batch, "text").to_pylist()])

    return source.mapInArrow(run, _OUT)


def _hashes(words: list[str], length: int) -> np.ndarray:
    """Hashes of runs of words that agree in all processes."""
    import xxhash

    return np.unique(np.fromiter((xxhash.xxh64_intdigest(" ".join(words[k : k + length])) for k in range(len(words) - length + 1)), np.uint64, max(0, len(words) - length + 1)))


def _by_join(source: DataFrame, known: DataFrame, threshold: float, width: int) -> DataFrame:
    """For item sets of any size: sketches meet the documents' shingles in a shuffle, then pairs are verified."""
    texts = source.withColumn("row", F.xxhash64("id", "text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, length_of, h = [], [], []
            for key, text in zip(column(batch, "key").to_pylist(), column(batch, "item").to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    length = min(width, len(words))
                    all_h = _hashes(words, length)
                    k = size_class(len(all_h))
                    some = all_h[: sketch_size(list(range(1 << k, 2 << k)), threshold)].view(np.int64).tolist()
                    keys += [key] * len(some)
                    length_of += [length] * len(some)
                    h += some
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(length_of, pa.int32()), pa.array(h, pa.int64())], names=["key", "length", "h"])

    keyed = known.withColumn("key", F.xxhash64("item_id", "item"))
    sketches = settle(keyed.select("key", "item").mapInArrow(sketch, "key long, length int, h long"), "item-sketches")
    lengths = [r.length for r in sketches.select("length").distinct().collect()]

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            for row, text in zip(column(batch, "row").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                words = words_of(text)
                for length in lengths:
                    h = _hashes(words, length).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row)), pa.array(np.full(len(h), length, np.int32)), pa.array(h)], names=["row", "length", "h"])

    seen = texts.select("row", "text").mapInArrow(shingle, "row long, length int, h long")
    pairs = settle(seen.join(sketches.hint("shuffle_merge"), ["length", "h"]).select("row", "key").distinct(), "item-pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            cols = [column(batch, c).to_pylist() for c in ("id", "text", "item_id", "item")]
            hits = []
            for _, text, item_id, item in zip(*cols, strict=True):
                s, words = shingles_of(words_of(item), width), words_of(text)
                length = len(next(iter(s)))
                shared = len(s & {tuple(words[k : k + length]) for k in range(len(words) - length + 1)})
                hits.append([(item_id, shared, len(s))] if shared >= needed(len(s), threshold) else [])
            yield _rows(cols[0], hits)

    both = pairs.join(texts.hint("shuffle_merge"), "row").join(keyed.hint("shuffle_merge"), "key")
    return both.select("id", "text", "item_id", "item").mapInArrow(verify, _OUT)


SQL = r"""
with items as (
  select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from (select distinct item_id, text from benchmark) b
), item_shingles as (
  select distinct item_id, array_to_string(w[k:k+4], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from items where len(w) > 0) x
), sizes as (select item_id, count(*) as n_item from item_shingles group by 1),
docs as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
doc_shingles as (
  select distinct doc_id, array_to_string(w[k:k+4], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from docs where len(w) > 4) x
), shared as (
  select doc_id, item_id, count(*) as n_shared from doc_shingles join item_shingles using (s) group by all
)
select doc_id, item_id, n_shared, n_item, n_shared::double / n_item as containment
from shared join sizes using (item_id) where n_shared::double / n_item >= 0.8
"""
