"""Quality classifier from weak labels: labellers' accuracies by expectation-maximisation, then a hashed scorer.

Labellers look at whole texts and vote good, bad or not at all. How often each votes right is estimated from
their agreement alone, over the vote patterns of all documents. The posterior labels of a bounded sample then
train a linear scorer on hashed features, which scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column
from lexipress.llm.units import UnitMemory
from lexipress.storage import settle

#: Documents that train the scorer, and the share of them that is set aside for the half with bad posteriors.
TRAIN_DOCS = 4000
BUCKETS = 1 << 16
ACCEPT = 0.5
_ASCII_WORD = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_SPACE = b" \t\n\r\x0b\x0c"
_END = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xbb", b"\x9d", b"\x82")
_MESSY = re.compile(rb"[!-/:-@\[-`{-~]{2,}(?=[ \t\n\r\x0b\x0c]|\Z)")
_RUN = re.compile(r"(.)\1+")

#: Labellers that find one kind of junk: a statistic, and the range in which they say bad; else they don't vote.
JUNK: tuple[tuple[str, float, float], ...] = (
    ("symbols", 0.09, 9.0),
    ("capitals", 0.15, 9.0),
    ("separators", 0.08, 9e9),
    ("messy", 0.12, 9.0),
    ("repeats", 0.12, 9.0),
    ("same_lines", 0.4, 9.0),
    ("packed", 0.0, 0.2),
    ("ended", 0.0, 0.1),
)
#: Labellers that say good: what must hold at once (a statistic's range); else they don't vote.
SOUND: tuple[tuple[tuple[str, float, float], ...], ...] = (
    (("symbols", 0.0, 0.06), ("capitals", 0.0, 0.06), ("separators", 0.0, 0.02), ("repeats", 0.0, 0.06), ("packed", 0.22, 9e9)),
    (("symbols", 0.0, 0.06), ("messy", 0.0, 0.03), ("capitals", 0.0, 0.06), ("ended", 0.5, 9.0), ("repeats", 0.0, 0.1)),
    (("repeats", 0.0, 0.06), ("same_lines", 0.0, 0.3), ("messy", 0.0, 0.03), ("separators", 0.0, 0.02), ("capitals", 0.0, 0.1)),
)
NAMES = tuple(x[0] for x in JUNK)
N_LABELLERS = len(JUNK) + len(SOUND)


def statistics(text: str | None) -> tuple[list[float], list[str]]:
    """What the labellers look at, and the text's words."""
    raw = (text or "").encode()
    words = (text or "").split()
    n = max(1, len(words))
    solid = raw.translate(None, _SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    short = min(len(raw), 1 << 20)
    packed = len(zlib.compress(raw[:short], 1)) / short if short else 0.0
    for k in range(1 << 20, len(raw), 1 << 20):  # whole text, a megabyte at a time
        packed = (packed * k + len(zlib.compress(raw[k : k + (1 << 20)], 1))) / min(len(raw), k + (1 << 20))
    return [
        len(solid.translate(None, _ASCII_WORD)) / max(1, len(solid)),
        len([w for w in words if w.isupper() and len(w) > 1]) / n,
        raw.count(b"|") / n,
        len(_MESSY.findall(raw)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        packed,
        sum(1 for x in lines if x.rstrip().endswith(_END)) / max(1, len(lines)),
    ], words


def votes(stats: list[float], n_words: int) -> str:
    """A letter per labeller: b (bad), g (good), or - for no vote. Texts without words get bad from all that find junk."""
    if not n_words:
        return "b" * len(JUNK) + "-" * len(SOUND)
    value = dict(zip(NAMES, stats, strict=True))
    if n_words < 50:  # short texts don't pack
        value["packed"] = 1.0
    if n_words < 10:  # nor do shares of a few words say much
        value["symbols"] = value["repeats"] = 0.0
    bad = ["b" if lo <= value[name] <= hi else "-" for name, lo, hi in JUNK]
    good = ["g" if all(lo <= value[name] <= hi for name, lo, hi in rule) else "-" for rule in SOUND]
    return "".join(bad + good)


@dataclass
class LabelModel:
    """Each labeller's accuracy: how often it's right when it votes. Not voting says nothing; classes weigh alike."""

    accuracy: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The chance of a good text, by vote pattern."""
        side = np.array([[{"g": 1, "b": -1, "-": 0}[v] for v in p] for p in patterns]).reshape(len(patterns), N_LABELLERS)
        return 1 / (1 + np.exp(-side @ np.log(self.accuracy / (1 - self.accuracy))))


def fit_labels(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    Expectation: posterior labels under the accuracies so far. Maximisation: a labeller's accuracy is the posterior
    share of its votes that are right (with 20 votes of the starting accuracy 0.8 on top, between 0.55 and 0.99)."""
    model = LabelModel(np.full(N_LABELLERS, 0.8))
    if not patterns:
        return model
    bad = np.array([[v == "b" for v in p] for p in patterns])
    voted = np.array([[v != "-" for v in p] for p in patterns])
    for _ in range(rounds):
        good = model.posterior(patterns)
        right = np.where(bad, (1 - good)[:, None], good[:, None]) * voted
        accuracy = np.clip((counts @ right + 16) / (counts @ voted + 20), 0.55, 0.99)
        done = np.abs(accuracy - model.accuracy).max() < 1e-6
        model = LabelModel(accuracy)
        if done:
            break
    return model


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


class Kinds(dict):
    """Each character's kind: capital, other letter, digit; any other character is its own."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = found = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return found


class Shapes(dict):
    """The bucket of a word's kinds of characters, runs of one kind as one; remembers kinds."""

    def __missing__(self, kinds: str) -> int:
        if len(self) > 20_000:
            self.clear()
        self[kinds] = found = _bucket("s:" + _RUN.sub(r"\1", kinds)[:12])
        return found


KINDS, SHAPES = Kinds(), Shapes()


def word_buckets(word: str) -> tuple[int, int]:
    """The buckets of a word's shape and of the word itself, in lower case."""
    return SHAPES[word.translate(KINDS)], zlib.crc32(b"w:" + word.lower().encode()) % BUCKETS


def _steps(stats: list[float]) -> list[int]:
    return [_bucket(f"x:{i}:{min(20, int(x * 20))}") for i, x in enumerate(stats)]


def features(stats: list[float], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: shapes of words (thrice) and words by their share, and each statistic's step."""
    pairs = np.array([word_buckets(w) for w in words], np.int64).reshape(-1, 2)
    shapes, n_shapes = np.unique(pairs[:, 0], return_counts=True)
    terms, n_terms = np.unique(pairs[:, 1], return_counts=True)
    steps = np.array(_steps(stats), np.int64)
    n = max(1, len(words))
    return np.concatenate((shapes, terms, steps)), np.concatenate((3 * n_shapes / n, n_terms / n, np.full(len(steps), 0.5)))


class Scorer:
    """The linear scorer. As it's linear, a word adds the weights of its shape (thrice) and of itself over the number
    of words; the sum of both is remembered for words that come again soon."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()
        self.words = UnitMemory(self._word)

    def _word(self, word: str) -> float:
        shape, term = word_buckets(word)
        return 3 * self.weights[shape] + self.weights[term]

    def log_odds(self, stats: list[float], words: list[str]) -> float:
        """That the text is good; 30 against it if it has no word."""
        if not words:
            return -30.0
        self.words.age()
        return sum(map(self.words.__getitem__, words)) / len(words) + 0.5 * sum([self.weights[s] for s in _steps(stats)]) + self.weights[-1]


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on posterior labels, classes weighted alike."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    good, bad = max(target.sum(), 1e-3), max((1 - target).sum(), 1e-3)
    weight = (target / good + (1 - target) / bad) / 2
    sums = np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, w[idx] * val, len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.append(np.bincount(idx, err[row] * val, BUCKETS), err.sum()) + decay * np.append(w[:-1], 0) / BUCKETS
        sums += grad**2
        w -= rate * grad / np.sqrt(sums)
    return w


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = TRAIN_DOCS) -> tuple[LabelModel, np.ndarray]:
    """The label model, from the votes on all documents, and the scorer, from at most ``sample`` of them.

    The sample takes the rows of least hash of id and text, half of it where the votes say bad more often than
    good, as far as there are such rows."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = []
            for text in column(batch, "text").to_pylist():
                stats, words = statistics(text)
                found.append(votes(stats, len(words)))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(found, pa.string()), column(batch, "h")], names=["id", "votes", "h"])

    source = _source(docs, id_col, text_col).withColumn("h", F.xxhash64("id", "text"))
    voted = settle(source.mapInArrow(vote, "id long, votes string, h long"), "votes")
    patterns = voted.groupBy("votes").count().collect()  # at most 2 ** labellers rows
    model = fit_labels([r["votes"] for r in patterns], np.array([r["count"] for r in patterns], float))
    bad = F.length(F.translate("votes", "g-", "")) > F.length(F.translate("votes", "b-", ""))
    half = [voted.where(b).select("h", "votes").distinct().orderBy("h", "votes").limit(sample // 2) for b in (bad, ~bad)]
    picked = {r.h: r["votes"] for part in half for r in part.collect()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [features(*statistics(text)) for text in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "h"), pa.array([r[0].astype(np.int32) for r in found], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in found], pa.list_(pa.float32()))],
                names=["h", "at", "value"],
            )

    wanted = docs.sparkSession.createDataFrame([(h,) for h in picked], "h long")
    some = source.join(F.broadcast(wanted), "h", "left_semi")  # at most ``sample`` hashes
    some = some.mapInArrow(rows, "h long, at array<int>, value array<float>").dropDuplicates(["h"]).collect()
    some.sort(key=lambda r: r.h)
    target = model.posterior([picked[r.h] for r in some]) if some else np.zeros(0)
    return model, train([(np.array(r["at"], np.int64), np.array(r.value)) for r in some], target)


def score(docs: DataFrame, model: LabelModel, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, weak_label double, accepted boolean) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights = sent.value
        scorer, seen = Scorer(weights), {}
        for batch in chunks(batches, "text"):
            scores, weak = [], []
            for text in column(batch, "text").to_pylist():
                stats, words = statistics(text)
                pattern = votes(stats, len(words))
                if pattern not in seen:
                    seen[pattern] = float(labels.posterior([pattern])[0])
                weak.append(seen[pattern])
                z = scorer.log_odds(stats, words)
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if words else 0.0)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(scores, pa.float64()), pa.array(weak, pa.float64()), pa.array([x >= ACCEPT for x in scores], pa.bool_())], names=["id", "score", "weak_label", "accepted"])

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, score double, weak_label double, accepted boolean").withColumnRenamed("id", id_col)


def select_accepted(docs: DataFrame, model: LabelModel, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the scorer accepts; nothing is shuffled.

    Null texts and texts without a word go. Repeated rows and null ids stay or go by their texts alone; columns keep
    their names and values, whatever they are called; an empty table gives an empty table."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, least = Scorer(sent.value), np.log(ACCEPT / (1 - ACCEPT))
        for batch in chunks(batches, text_col):
            keep = []
            for text in column(batch, text_col).to_pylist():
                stats, words = statistics(text)
                keep.append(bool(words) and scorer.log_odds(stats, words) >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = TRAIN_DOCS) -> DataFrame:
    """(id, score, weak_label, accepted), a row per row of ``docs``.

    ``score``: the scorer's chance that the text is good; ``weak_label``: the labellers' posterior. Null texts and
    texts without a word are rejected with score 0. Null ids and repeated rows are kept as rows, equal texts get
    equal scores, an empty table gives an empty table, other columns are ignored. Texts are read three times,
    of which the second keeps the sample's only, and never shuffled; to the driver go vote patterns (at most 2 to the
    number of labellers) and the features of at most ``sample`` documents.
    """
    return score(docs, *fit(docs, id_col, text_col, sample), id_col, text_col)
