"""Language-model scores of whole documents: corpus counts by Spark, a recurrent model trained in tasks, scored in blocks."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexipress.llm import gru
from lexipress.llm._arrow import chunks, column
from lexipress.storage import settle

#: Frequent words, which have a chance of their own in the model; endings of rare words that are a class of their own,
#: and classes that the other endings share.
FREQUENT, ENDINGS, SHARED = 2048, 96, 32
#: The recurrent weights are trained on all training tokens. They start from ROUNDS rounds on whole documents of least hash
#: that hold about one in TRAIN_SHARE of the tokens, but TRAIN_TOKENS at least, in SHARDS parts at least. Parts grow with
#: the root of that number, to PART_TOKENS, and so does their number. After each round weights are averaged, AVERAGED
#: models at once.
TRAIN_SHARE, TRAIN_TOKENS, SHARDS, PART_TOKENS, ROUNDS, AVERAGED = 256, 400_000, 6, 2_000_000, 3, 16
#: Then every chunk of documents is read once, in PASSES turns with these rates, each task from the same weights.
PASSES = (0.004, 0.002)
END = "\n"  # no word holds white space


def raw_tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end, in UTF-8."""
    words = (text or "").encode().lower().split()
    words.append(b"\n")
    return words


def tokens_of(text: str | None) -> list[str]:
    return [w.decode() for w in raw_tokens(text)]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def in_training(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 1, F.lit(False))


@dataclass
class Classes:
    """Where each word is: a frequent one has a class and a place in it; a rare or unknown one has its ending's class."""

    frequent: dict[str, int]
    endings: dict[str, int]
    mass: np.ndarray  # of each class of rare words: sum of count + 0.5, and 0.5 for what is unknown

    @property
    def n_frequent(self) -> int:
        return -(-len(self.frequent) // gru.MEMBERS)

    @property
    def n_classes(self) -> int:
        return self.n_frequent + ENDINGS + SHARED

    @property
    def n_inputs(self) -> int:
        return len(self.frequent) + ENDINGS + SHARED

    def ending(self, word: str) -> int:
        e = word[-2:]
        return self.endings[e] if e in self.endings else ENDINGS + zlib.crc32(e.encode()) % SHARED

    def place(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input, class and member of each word; the member of a rare word is -1."""
        f = [self.frequent.get(w, -1) for w in words]
        rare = [0 if x >= 0 else self.ending(w) for x, w in zip(f, words, strict=True)]
        f, rare = np.array(f, np.int64), np.array(rare, np.int64)
        known = f >= 0
        return np.where(known, f, len(self.frequent) + rare), np.where(known, f // gru.MEMBERS, self.n_frequent + rare), np.where(known, f % gru.MEMBERS, -1)


def _ending_class(word: Column, endings: list[str]) -> Column:
    e = F.right(word, F.lit(2))
    own = F.array_position(F.array(*[F.lit(x) for x in endings]), e) if endings else F.lit(0)
    return F.when(own > 0, own - 1).otherwise(F.lit(ENDINGS) + F.crc32(e) % SHARED).cast("int")


def _squeeze(tokens: np.ndarray) -> bytes:
    """Small integers, byte plane by byte plane, compressed."""
    return zstandard.compress(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _blocks(source: DataFrame) -> DataFrame:
    """A row per chunk of documents: their tokens as places in the chunk's list of words (compressed), the list, and its
    words' training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            at: dict[bytes, int] = defaultdict(count().__next__)  # in order of appearance
            tokens = [np.array([at[w] for w in raw_tokens(t)], np.int32) for t in column(batch, "text").to_pylist()]
            lengths = np.array([len(t) for t in tokens])
            tokens = np.concatenate(tokens)
            order = np.argsort(-np.bincount(tokens, minlength=len(at)), kind="stable")  # frequent words get small places
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            tokens, found = place[tokens].astype(np.int32), list(at)
            words = [found[i].decode() for i in order.tolist()]
            learn = np.repeat(column(batch, "learn").to_numpy(zero_copy_only=False).astype(bool), lengths)
            n = np.bincount(tokens[learn], minlength=len(words)).astype(np.int64)
            key = int.from_bytes(np.random.default_rng().bytes(8), "little", signed=True)
            row = [[key], [column(batch, "id").to_pylist()], [column(batch, "held_out").to_pylist()], [lengths.astype(np.int32)], [_squeeze(tokens)], [words], [n]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
            names = ["block", "ids", "held_out", "lengths", "tokens", "words", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)

    return source.mapInArrow(run, "block long, ids array<long>, held_out array<boolean>, lengths array<int>, tokens binary, words array<string>, counts array<long>")


def _counts(blocks: DataFrame) -> DataFrame:
    """(block, at, word, c): each chunk's words with their count in all training texts; the word itself only once, in one of
    its rows. Counts are summed in each task first and come back by a join, which Spark splits where a word of many chunks
    holds a large share of the rows."""
    seen = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("block", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    known = seen.groupBy("word").agg(F.sum("n").alias("c"), F.min("block").alias("home")).where("c > 0")
    counted = seen.drop("n").join(known.hint("shuffle_merge"), "word")
    return settle(counted.select("block", "at", F.when(F.col("block") == F.col("home"), F.col("word")).alias("word"), "c"), "lm-counts")


def _classes(vocabulary: DataFrame) -> tuple[Classes, np.ndarray]:
    """The classes, and the frequent words' counts, in order."""
    top = vocabulary.where(F.col("word") != END).orderBy(F.col("c").desc(), "word").limit(FREQUENT - 1).collect()
    end = vocabulary.where(F.col("word") == END).first()
    rows = sorted([(END, end.c if end else 0), *((r.word, r.c) for r in top)], key=lambda r: (-r[1], r[0]))
    frequent = {w: i for i, (w, _) in enumerate(rows)}
    names = vocabulary.sparkSession.createDataFrame([(w,) for w in frequent], "word string")
    rare = vocabulary.join(F.broadcast(names), "word", "left_anti")  # at most FREQUENT rows
    endings = [r.e for r in rare.groupBy(F.right("word", F.lit(2)).alias("e")).agg(F.sum("c").alias("c")).orderBy(F.col("c").desc(), "e").limit(ENDINGS).collect()]
    mass = np.full(ENDINGS + SHARED, 0.5)
    for r in rare.groupBy(_ending_class(F.col("word"), endings).alias("k")).agg(F.sum(F.col("c") + F.lit(0.5)).alias("m")).collect():
        mass[r.k] += r.m
    return Classes(frequent, {e: i for i, e in enumerate(endings)}, mass), np.array([c for _, c in rows], float)


def sample_size(n_tokens: int) -> tuple[int, int]:
    """How many tokens the recurrent weights start from, of ``n_tokens``, and in how many parts."""
    wanted = min(n_tokens, max(TRAIN_TOKENS, n_tokens // TRAIN_SHARE))
    part = min(PART_TOKENS, TRAIN_TOKENS / SHARDS * max(1.0, wanted / TRAIN_TOKENS) ** 0.5)
    return wanted, max(SHARDS, math.ceil(wanted / part))


def _train(source: DataFrame, blocks: DataFrame, classes: Classes, counts: np.ndarray, n_tokens: int) -> gru.Gru:
    """Local training on all training texts, weights averaged after each turn."""
    model = _start(source, classes, counts, n_tokens)
    if not n_tokens:
        return model
    for turn in range(len(PASSES)):
        found = settle(_learned(blocks, model, classes, turn), "lm-models")
        left = found.count()  # a row a task
        model = _mean(found.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(max(1, left))).cast("int")), left, model)
    return model


def _learned(blocks: DataFrame, model: gru.Gru, classes: Classes, turn: int) -> DataFrame:
    """(shard, n, model): what each task makes of ``model`` from all training tokens of its chunks of that turn, and how many
    these are. A chunk's turn is by the hash of its ids."""
    sent, rate, turns = model.to_bytes(), PASSES[turn], len(PASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, start, n, shard = gru.Adam(gru.Gru.from_bytes(sent)), classes.frequent[END], 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: column(batch, name)[i].values  # noqa: B023, E731
                lengths = get("lengths").to_numpy().astype(np.int64)
                learn = get("ids").is_valid().to_numpy(zero_copy_only=False) & ~get("held_out").to_numpy(zero_copy_only=False).astype(bool)
                t = _unsqueeze(column(batch, "tokens")[i].as_py())[np.repeat(learn, lengths)]
                inputs, kinds, members = (x.astype(np.int32)[t] for x in classes.place(get("words").to_pylist()))
                gru.learn(adam, inputs, kinds, np.maximum(members, 0, out=members), lengths[learn], start, rate)
                n, shard = n + len(t), shard or int(column(batch, "block")[i].as_py() & 0x7FFFFFFF)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(n)]), pa.array([adam.model.to_bytes()], pa.binary())], names=["shard", "n", "model"])

    part = F.pmod(F.xxhash64("ids"), F.lit(turns))
    return blocks.where(part == turn).select("block", "ids", "held_out", "lengths", "tokens", "words").mapInArrow(run, _MODEL)


def _mean(found: DataFrame, left: int, model: gru.Gru) -> gru.Gru:
    """The average of models (shard, n, model) with shards below ``left``; ``model`` if there are none."""
    while left > AVERAGED:
        left = -(-left // AVERAGED)
        found = settle(found, "lm-models").groupBy((F.col("shard") % left).alias("shard")).applyInPandas(_averaged, _MODEL)
    found = found.collect()  # few models
    return gru.average([(p.n, gru.Gru.from_bytes(bytes(p.model))) for p in sorted(found, key=lambda p: p.shard)]) if found else model


def _start(source: DataFrame, classes: Classes, counts: np.ndarray, n_tokens: int) -> gru.Gru:
    """The weights that training starts from: words' frequencies, and rounds on parts of some texts."""
    n = classes.n_frequent
    member = np.full((n, gru.MEMBERS), -1e4)
    member.ravel()[: len(counts)] = np.log(counts + 0.5)
    both = np.concatenate((np.exp(member).sum(axis=1), classes.mass))
    model = gru.Gru.fresh(classes.n_inputs, np.log(both / both.sum()), member)
    if not n_tokens:
        return model
    wanted, parts = sample_size(n_tokens)
    cut = int((1 << 40) * (wanted / n_tokens)) + 1
    sample = source.where("learn").where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < cut)
    start = classes.frequent[END]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [classes.place(tokens_of(t)) for t in column(batch, "text").to_pylist()]
            cols = [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *cols], names=["id", "inputs", "classes", "members"])

    placed = sample.select("id", "text").mapInArrow(place, "id long, inputs array<int>, classes array<int>, members array<int>")
    placed = settle(placed.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")), "lm-sample")
    for turn in range(ROUNDS):
        sent = model.to_bytes()

        def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id")
            texts = [(np.asarray(a), np.asarray(b), np.maximum(np.asarray(c), 0)) for a, b, c in zip(rows["inputs"], rows["classes"], rows["members"], strict=True)]
            out = gru.train(gru.Gru.from_bytes(sent), texts, start, rate=0.01 / (1 + turn), seed=turn)  # noqa: B023
            return pd.DataFrame({"shard": [key[0]], "n": [float(sum(len(t[0]) for t in texts))], "model": [out.to_bytes()]})

        model = _mean(placed.repartition(parts, "shard").groupBy("shard").applyInPandas(fit, _MODEL), parts, model)
    return model


_MODEL = "shard int, n double, model binary"


def _averaged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("shard")
    model = gru.average([(n, gru.Gru.from_bytes(bytes(m))) for n, m in zip(rows["n"], rows["model"], strict=True)])
    return pd.DataFrame({"shard": [key[0]], "n": [rows["n"].sum()], "model": [model.to_bytes()]})


_OUT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``.

    Learns from rows whose crc32 of the id as text isn't 1 modulo 5. ``base_score``: log10 of the words' smoothed
    frequencies; ``score``: the recurrent model's log10 chance of the whole text. The model gives a class a chance and,
    within it, a frequent word a softmax's, a rare word its share of the class's counts, an unknown word the share of
    0.5 counts. Null and empty texts are one end. Null ids don't take part in learning and aren't held out; repeated
    rows stay rows and count as often; other columns are ignored; an empty table gives an empty table.

    The recurrent weights learn from all training tokens: every chunk is read once by a task that starts from the same
    weights, and tasks' weights are averaged by their tokens. Counts cover all training texts: chunks of documents give their different words, which meet the corpus counts in a
    join and return to their chunk. Texts are read twice, never shuffled; a chunk is bounded in bytes.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"), in_training(id_col).alias("learn"))
    blocks = settle(_blocks(source), "lm-blocks")
    counted = _counts(blocks)
    vocabulary = counted.where("word is not null").select("word", "c")
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    classes, frequent = _classes(vocabulary)
    model = _train(source, blocks, classes, frequent, size.n)
    known = counted.groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("known"))  # the different words of a chunk
    sent = docs.sparkSession.sparkContext.broadcast((model.to_bytes(), classes))
    n, v = size.n, size.v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, where = sent.value
        model = gru.Gru.from_bytes(data)
        start = where.frequent[END]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda name: column(row, name)[0].values  # noqa: B023, E731
                words = get("words").to_pylist()
                c = np.zeros(len(words))
                found = column(row, "known")[0]
                if found.is_valid:
                    c[found.values.field("at").to_numpy()] = found.values.field("c").to_numpy()
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                inputs, kinds, members = where.place(words)
                rare = members < 0
                inner = np.zeros(len(words))
                inner[rare] = np.log((c[rare] + 0.5) / where.mass[kinds[rare] - where.n_frequent])
                t, lengths = _unsqueeze(column(row, "tokens")[0].as_py()), get("lengths").to_numpy().astype(np.int64)
                logs = model.score(inputs[t], kinds[t], np.maximum(members, 0)[t], lengths, start).astype(np.float64) + inner[t]
                cuts = np.cumsum(lengths) - lengths
                add = lambda x: np.add.reduceat(x, cuts) if len(cuts) else np.zeros(0)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [get("ids"), get("held_out"), pa.array(lengths), pa.array(add((c > 0)[t].astype(np.int64)), pa.int64()), pa.array(np.full(len(lengths), n)), pa.array(add(base[t])), pa.array(add(logs) / np.log(10))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = blocks.select("block", "ids", "held_out", "lengths", "tokens", "words").join(known.hint("shuffle_merge"), "block", "left")
    return rows.drop("block").mapInArrow(run, _OUT).withColumnRenamed("id", id_col)
