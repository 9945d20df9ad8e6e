"""SimHash near-duplicates: fingerprints, links found by the generalised pigeonhole principle, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column
from lexipress.operators.graph import connected_components
from lexipress.storage import settle

BITS = 64
#: MinHash values of a text's shingles: bands of rows. Texts 0.8 alike share a band with a chance of 0.9997.
BANDS, ROWS = 20, 5
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
SEED = 42
#: A bucket with more distinct fingerprints than this isn't paired up; its members link through shared neighbours.
BUCKET_PAIRS = 64
#: Counters of shingles by hash, which only order them, and rounds of stars before what is left is compared exactly.
CELLS, STAR_ROUNDS = 1 << 17, 2
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 15


def text_fingerprint(text: str | None, width: int) -> int:
    """The fingerprint of one text, as an unsigned integer.

    Words are runs of bytes other than space and \\t..\\r, with A-Z in lower case. Shingles are ``width`` words,
    repeats included (fewer words: the whole sequence; none: the fingerprint is 0). A bit is 1 if more than half
    of the shingles' XXH64 values (seed 42) have it.
    """
    parts = shingles(text, width)
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(parts), COUNT_ROWS):
        count += _bit_counts(_hashes(parts[k : k + COUNT_ROWS]))
    return int(np.packbits(2 * count > len(parts), bitorder="little").view("<u8")[0])


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def shingles(text: str | None, width: int) -> list[bytes]:
    """The text's shingles in order, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    if len(words) <= width:
        return [joined]
    return [joined[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id long, fp long): the fingerprint of every whole text, as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            fp = np.array([text_fingerprint(t, width) for t in column(batch, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fp long")


@dataclass(frozen=True)
class Part:
    """Bits that are compared together, and how many of them may differ; below 0 the part isn't probed."""

    bits: tuple[int, ...]
    threshold: int

    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """What to xor to a fingerprint so that its bits here come within the threshold."""
        return [_signed(sum(1 << b for b in some)) for t in range(self.threshold + 1) for some in itertools.combinations(self.bits, t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bit i and bit j (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = column(batch, "fp").to_numpy(zero_copy_only=False).astype("<i8")
            for k in range(0, len(fp), COUNT_ROWS):
                x = np.unpackbits(fp[k : k + COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (x.T @ x).astype(np.float64)
                n += len(x)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r.cell] = r.n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """Splits the bits into m groups of about the same size; each next bit joins the open group with whose bits
    it correlates most, bits of the strongest correlation first."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    order = sorted(range(BITS), key=lambda b: (-corr[b].max(), b))
    groups: list[list[int]] = [[] for _ in range(m)]
    most = -(-BITS // m)
    for b in order:
        room = [g for g in range(m) if len(groups[g]) < most]
        best = max(room, key=lambda g: (np.mean(corr[b, groups[g]]) if groups[g] else 1.0 / (1 + b), -len(groups[g]), -g))
        groups[best].append(b)
    return [tuple(sorted(g)) for g in groups]


def allot(groups: list[tuple[int, ...]], equal_pairs: list[float], n: int, both: np.ndarray, distance: int) -> tuple[float, list[Part]]:
    """Thresholds per group with the least estimated work, by dynamic programming.

    Any two fingerprints within ``distance`` are within threshold in at least one group if the thresholds, each
    -1 at least, sum up to distance - groups + 1. ``equal_pairs``: pairs that agree on a whole group, counted
    over all fingerprints; for one and more differing bits they are scaled by the bits' own frequencies. The
    work is candidate pairs plus probed keys.
    """
    p = np.diag(both) / max(n, 1)
    ratio = 2 * p * (1 - p) / np.maximum(p**2 + (1 - p) ** 2, 1e-12)
    cost = []
    for bits, pairs in zip(groups, equal_pairs, strict=True):
        poly, probes, row = [1.0] + [0.0] * distance, 1.0, {-1: 0.0}
        for b in bits:
            for t in range(distance, 0, -1):
                poly[t] += poly[t - 1] * ratio[b]
        for t in range(distance + 1):
            probes = sum(float(np.prod([(len(bits) - i) / (i + 1) for i in range(k)])) for k in range(t + 1))
            row[t] = max(pairs, 1.0) * sum(poly[: t + 1]) + n * probes
        cost.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t, extra in row.items():
                if total + t not in step or c + extra < step[total + t][0]:
                    step[total + t] = (c + extra, [*ts, t])
        best = step
    c, ts = best[distance - len(groups) + 1]
    return c, [Part(bits, t) for bits, t in zip(groups, ts, strict=True)]


def _key(part: Part, fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(part.mask()))


def _index(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """(part, key, fp, rep): each fingerprint under its bits in each part."""
    keys = F.array(*[F.struct(F.lit(i).alias("part"), _key(p, F.col("fp")).alias("key")) for i, p in enumerate(parts)])
    return nodes.select("fp", "rep", F.inline(keys))


def plan(nodes: DataFrame, distance: int = 2, sizes: tuple[int, ...] = (2, 3, 4)) -> list[Part]:
    """Parts and thresholds with the least estimated work among several numbers of parts."""
    n, both = bit_statistics(nodes)
    options = [correlated_groups(n, both, m) for m in sizes]
    flat = [Part(bits, 0) for groups in options for bits in groups]
    found = _index(nodes, flat).groupBy("part", "key").agg(F.count("*").alias("c")).groupBy("part").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()
    pairs, at, best = {r.part: float(r.pairs) for r in found}, 0, None
    for groups in options:
        some = allot(groups, [pairs.get(at + i, 0.0) for i in range(len(groups))], n, both, distance)
        at += len(groups)
        best = some if best is None or some[0] < best[0] else best
    return [p for p in best[1] if p.threshold >= 0]


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(src, dst): pairs of ``rep`` of distinct fingerprints (fp, rep) that, closed transitively, link exactly the
    fingerprints within ``distance``.

    Probed keys meet the keys of a part; a pair is verified on all 64 bits. Buckets of over BUCKET_PAIRS
    fingerprints aren't paired up: their members, and whatever probes them, link instead to the smallest
    fingerprint among those that share a value one bit away (at most ``distance`` 2 apart exactly if they share
    one), which takes 65 rows a fingerprint however large the bucket is.
    """
    if distance != 2:
        raise ValueError("links are built for 2 differing bits")
    parts = plan(nodes, distance)
    index = settle(_index(nodes, parts), "simhash-index")
    hot = settle(index.groupBy("part", "key").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET_PAIRS).select("part", "key"), "simhash-hot")
    flips = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(x).alias("flip")) for i, p in enumerate(parts) for x in p.flips()])
    probes = nodes.select("fp", "rep", F.inline(flips))
    key = F.lit(None).cast("long")
    for i, p in enumerate(parts):
        key = F.when(F.col("part") == i, F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(p.mask()))).otherwise(key)
    probes = probes.withColumn("key", key).drop("flip")
    calm = probes.join(hot.hint("shuffle_merge"), ["part", "key"], "left_anti")
    other = index.select("part", "key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance
    pairs = calm.join(other.hint("shuffle_merge"), ["part", "key"]).where(close & (F.col("fp") != F.col("fp2"))).select(F.col("rep").alias("src"), F.col("rep2").alias("dst"))
    crowd = settle(probes.join(hot.hint("shuffle_merge"), ["part", "key"], "left_semi").select("fp", "rep").distinct(), "simhash-crowd")
    ball = F.array(F.lit(0), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    near = crowd.select("rep", "fp", F.explode(ball).alias("bit")).select("rep", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
    first = near.groupBy("z").agg(F.min("rep").alias("dst"), F.count("*").alias("c")).where("c > 1").drop("c")
    stars = near.join(first.hint("shuffle_merge"), "z").where("rep <> dst").select(F.col("rep").alias("src"), "dst")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(id, fingerprint string, component_id long), a row per row of ``docs``.

    ``fingerprint``: 16 hexadecimal digits; ``component_id``: the smallest id reachable over links of at most
    ``distance`` differing bits, the row's own included. Null and empty texts have fingerprint zero, which links
    like any other. Rows with a null id keep their fingerprint and get the component of the rows that share it
    (null if none of those has an id). Repeated rows stay rows; an empty table gives an empty table; other
    columns are ignored. Texts leave the first step as 16 bytes; the rest works on distinct fingerprints.
    """
    rows = settle(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = settle(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    component = connected_components(links(nodes, distance)).withColumnRenamed("node", "rep")
    named = nodes.join(component.hint("shuffle_merge"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = settle(named, "simhash-components")
    return rows.join(named.hint("shuffle_merge"), "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketch(text: str | None, width: int) -> tuple[int, int, int, list[int]]:
    """Fingerprint, digest and size of the set of shingles, and a key per band."""
    parts = shingles(text, width)
    if not parts:
        return 0, 0, 0, []
    h = _hashes(parts)
    count = sum(_bit_counts(h[k : k + COUNT_ROWS]) for k in range(0, len(h), COUNT_ROWS))
    fp = int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])
    h = np.unique(h)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(h), 2048):
        low = np.minimum(low, ((h[k : k + 2048, None] * _MULTIPLY + _ADD) >> np.uint64(11)).min(axis=0))
    keys = [_signed(xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes())) for b in range(BANDS)]
    return fp, _signed(xxhash.xxh64_intdigest(h.tobytes())), len(h), keys


def _crowd_prefixes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(rep, n, at, h): the first shingles of each text in an order that all texts share, about the rarest first.

    Two texts at least ``similarity`` alike have one of them in common whatever the order is: n - ceil(similarity * n) + 1
    of n. The order is by counts over all ``texts``, summed by hash into CELLS counters, then by the hash itself.
    """

    def hashed(text: str | None) -> np.ndarray:
        return np.unique(_hashes(shingles(text, width)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in chunks(batches, "text"):
            for t in column(batch, "text").to_pylist():
                n += np.bincount((hashed(t) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    rank = np.zeros(CELLS, np.uint8)
    for r in texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        rank[r.cell] = round(4 * np.log2(r.n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            for i, t in zip(column(batch, "id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                h = hashed(t)
                first = np.lexsort((h, rank[(h % np.uint64(CELLS)).astype(np.int64)]))[: len(h) - int(np.ceil((similarity - 1e-9) * len(h))) + 1]
                m = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i, np.int64)), pa.array(np.full(m, len(h), np.int64)), pa.array(np.arange(m)), pa.array(h[first].view(np.int64))], names=["rep", "n", "at", "h"])

    return settle(texts.select("id", "text").mapInArrow(cut, "rep long, n long, at long, h long"), "crowd-prefixes")


def _across(prefixes: DataFrame, component: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """(a, b): pairs of texts of different groups that may be alike by their prefixes, sizes and places.

    If ``exact``, all of them. Else shingles with over BUCKET_PAIRS texts give two pairs a text, with a text of the
    smallest group and one of the largest, so that groups grow before everything that is left is paired up.
    """
    label = component.select(F.col("node").alias("rep"), "component")
    rows = prefixes.join(label.hint("shuffle_merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = settle(rows, "crowd-rows")
    one = F.struct("component", "rep", "n", "at")
    mixed = rows.groupBy("h").agg(F.count("*").alias("c"), F.min(one).alias("low"), F.max(one).alias("high")).where("low.component <> high.component")
    if exact:
        rows = settle(rows.join(mixed.select("h").hint("shuffle_merge"), "h", "left_semi"), "crowd-mixed")
        met = rows.join(rows.select("h", *[F.col(c).alias(f"{c}2") for c in ("component", "rep", "n", "at")]).hint("shuffle_merge"), "h").where("rep < rep2")
    else:
        pivots = settle(mixed.where(F.col("c") > BUCKET_PAIRS).select("h", "low", "high"), "crowd-pivots")
        met = rows.join(pivots.hint("shuffle_merge"), "h").select("rep", "n", "at", "component", F.explode(F.array("low", "high")).alias("p"))
        met = met.select("rep", "n", "at", "component", *[F.col(f"p.{c}").alias(f"{c}2") for c in ("component", "rep", "n", "at")])
    t = similarity - 1e-9
    met = met.where("component <> component2").where(f"least(n, n2) >= {t} * greatest(n, n2)")
    return met.where(f"(least(n - at, n2 - at2)) * (1 + {t}) >= {t} * (n + n2)").select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, fp, digest, n) and sets (fp, digest, n, id, key, component): each row's text as a digest (``key``) and its
    set of shingles; each different set with the row of least (id, key) that has it, and its group.

    64 bits can't tell which texts are alike: texts 0.8 to 1 alike differ in 4 to 18 bits, as many as some unlike ones. So
    texts whose fingerprints link are candidates, and so are those that share a band of MinHash values; each pair of
    candidates is verified on its shingles. Texts with the same set are one before that. In buckets of over
    BUCKET_PAIRS different texts, each meets the bucket's first, last and middle text (by hash) first; then all texts of
    such buckets that aren't in one group by now are compared exactly (``_crowd_prefixes``, ``_across``).
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    key = F.md5(F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [_sketch(t, width) for t in column(batch, "text").to_pylist()]
            fp, digest, n, keys = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "key"), pa.array(fp, pa.int64()), pa.array(digest, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "key", "fp", "digest", "n", "keys"])

    rows = settle(source.withColumn("key", F.unhex(key)).mapInArrow(run, "id long, key binary, fp long, digest long, n long, keys array<long>"), "sketches")
    sets = rows.groupBy("fp", "digest", "n").agg(F.min(F.struct("id", "key")).alias("one"), F.first("keys").alias("keys"))
    # Numbers of sets follow ids: the first text of a bucket or group is its oldest, which its later copies are most alike to.
    sets = sets.select("fp", "digest", "n", "one.id", "one.key", "keys").repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    sets = settle(sets.withColumn("rep", F.monotonically_increasing_id()), "sketch-sets")
    bands = settle(sets.select("rep", "n", F.posexplode("keys").alias("band", "hash")), "sketch-bands")
    size = bands.groupBy("band", "hash").agg(F.count("*").alias("c"), F.array(F.min("rep"), F.max("rep"), F.min_by("rep", F.xxhash64("rep"))).alias("pivots")).where("c > 1")
    size = settle(size, "sketch-buckets")
    small = bands.join(size.where(F.col("c") <= BUCKET_PAIRS).select("band", "hash").hint("shuffle_merge"), ["band", "hash"])
    other = small.select("band", "hash", F.col("rep").alias("rep2"), F.col("n").alias("n2"))
    alike = "least(n, n2) >= {0} * greatest(n, n2)".format(similarity - 1e-9)
    pairs = small.join(other.hint("shuffle_merge"), ["band", "hash"]).where("rep < rep2").where(alike).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    large = size.where(F.col("c") > BUCKET_PAIRS).select("band", "hash", "pivots")
    stars = bands.join(large.hint("shuffle_merge"), ["band", "hash"]).select("rep", F.explode("pivots").alias("pivot")).where("rep <> pivot")
    nodes = sets.where("n > 0").groupBy("fp").agg(F.min("rep").alias("rep"))
    near = links(settle(nodes, "simhash-nodes"))
    twins = sets.where("n > 0").join(nodes.withColumnRenamed("rep", "low").hint("shuffle_merge"), "fp").where("rep <> low")
    every = pairs.unionByName(stars.select(F.col("rep").alias("a"), F.col("pivot").alias("b"))).unionByName(near.select(F.col("src").alias("a"), F.col("dst").alias("b"))).unionByName(twins.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    repeated = not rows.groupBy("id").count().where("count > 1").isEmpty()

    def texts_of(reps: DataFrame, name: str) -> DataFrame:
        """(rep, text): the text of the row that stands for each set; one of several rows that are alike."""
        wanted = sets.select("rep", "id", F.col("key").alias("wanted")).join(reps.hint("shuffle_merge"), "rep", "left_semi")
        texts = source.join(wanted.hint("shuffle_merge"), "id").where(F.unhex(key) == F.col("wanted")).select("rep", "text")
        return settle(texts.groupBy("rep").agg(F.first("text").alias("text")) if repeated else texts, name)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "left"):
            keep = []
            for x, y in zip(column(batch, "left").to_pylist(), column(batch, "right").to_pylist(), strict=True):
                x, y = set(shingles(x, width)), set(shingles(y, width))
                keep.append(len(x & y) >= (similarity - 1e-9) * len(x | y))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(some: DataFrame) -> DataFrame:
        some = settle(some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        texts = texts_of(some.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "candidate-texts")
        both = some.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("left")).hint("shuffle_merge"), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("right")).hint("shuffle_merge"), "b")
        return settle(both.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long"), "similar")

    edges = verified(every)
    if not large.isEmpty():
        crowd = bands.join(large.select("band", "hash").hint("shuffle_merge"), ["band", "hash"], "left_semi").select("rep").distinct()
        prefixes = _crowd_prefixes(texts_of(crowd, "crowd-texts").withColumnRenamed("rep", "id"), width, similarity)
        for turn in range(STAR_ROUNDS + 1):
            last = turn == STAR_ROUNDS
            found = settle(_across(prefixes, connected_components(edges, "a", "b"), similarity, exact=last), "crowd-pairs")
            if last or not found.isEmpty():
                edges = settle(edges.unionByName(verified(found)), "similar")
    component = connected_components(edges, "a", "b").withColumnRenamed("node", "rep")
    named = sets.drop("keys").join(component.hint("shuffle_merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).drop("rep")
    return rows.drop("keys"), settle(named, "similar-sets")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id), a row per distinct pair of a non-null id and a text: groups of texts of which each is at least
    ``similarity`` alike (Jaccard, on sets of shingles of ``width`` words) to another of its group, by their smallest id.

    Texts without a word are one group. An id with several texts has a row for each; equal rows are one.
    """
    rows, sets = _grouped(docs, id_col, text_col, width, similarity)
    low = sets.groupBy("component").agg(F.min("id").alias("component_id"))
    named = settle(sets.select("fp", "digest", "n", "component").join(low.hint("shuffle_merge"), "component").drop("component"), "similar-names")
    each = rows.select("id", "key", "fp", "digest", "n").distinct()
    return each.join(named.hint("shuffle_merge"), ["fp", "digest", "n"]).select(F.col("id").alias(id_col), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, text_md5): of each group of ``similar_components`` the row that stays, as its id and its text's md5 in binary: the
    smallest id, and of its texts in the group that of least md5."""
    sets = _grouped(docs, id_col, text_col, width, similarity)[1]
    best = sets.groupBy("component").agg(F.min(F.struct("id", "key")).alias("one"))
    return best.select(F.col("one.id").alias(id_col), F.col("one.key").alias("text_md5"))
