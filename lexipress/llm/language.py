"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column

BUCKETS = 1 << 16
#: Labelled documents of each language that the n-gram table is fitted on (about; those of least hash).
TRAIN_DOCS = 1500
#: Languages that can be learned; more is an error, not a silent cut.
MOST_LANGUAGES = 500
#: Log odds that a change of language between two words costs.
SWITCH = 7.0
#: The least log odds of a word in a language that its script allows, so that no single word outweighs its neighbours.
FLOOR = -6.0
#: What a word costs in a language that its script bars, more than changes there and back.
BARRED = -1e4
#: Scripts written without spaces, and the most characters of a run of them, or the like, that are scored as one word.
UNSPACED, PIECE = ("han", "kana", "bopomofo", "thai", "lao", "khmer", "burmese", "tibetan"), 4
#: A language takes part in a word's candidates if at least this share of its training letters is of the word's script.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Bytes that a task's remembered words take, about.
MEMORY_BYTES = 48 << 20

# First code point of each script range; 0 is Latin and everything not listed.
SCRIPTS: tuple[tuple[int, str], ...] = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"),
    (0x3190, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def letters_of(token: str) -> str:
    """The token's letters in lower case, other characters as spaces."""
    return token.lower() if token.isalpha() else "".join(c if c.isalpha() else " " for c in token.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 1- to 4-grams of the words' letters, with borders, and the word each belongs to."""
    text = "\n" + "\n".join([f" {w} " for w in words]) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    line, blank = codes == 10, codes == 32
    word = np.cumsum(line) - 1
    keys, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    bad = np.zeros(len(codes), bool)
    for n in range(1, 5):
        size = len(codes) - n + 1
        if size < 1:
            break
        h = h[:size] * np.uint64(0x100000001B3) ^ codes[n - 1 :]
        h *= np.uint64(0x9E3779B97F4A7C15)
        bad = bad[:size] | line[n - 1 :]
        inner = np.zeros(size, bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + size]
        ok = ~bad & ~inner
        ok &= ~(blank[:size] & blank[n - 1 :]) if n < 3 else True
        keys.append(((h[ok] >> np.uint64(29)) + np.uint64(n)) % np.uint64(BUCKETS))
        owners.append(word[:size][ok])
    return np.concatenate(keys).astype(np.int64), np.concatenate(owners)


_UNSPACED = np.array([n in UNSPACED for n in _NAMES])
_NOT_LATIN = re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for (a, n), b in zip(SCRIPTS, [*(x for x, _ in SCRIPTS[1:]), 0x110000], strict=True) if n != "latin") + "]")


def pieces_of(token: str) -> tuple[str, ...]:
    """The token cut where the script of its letters changes, and runs of scripts without spaces into PIECE letters at most.

    What isn't a letter, marks on letters among it, stays with the letters before it, or at the start with those after it.
    """
    if token.isascii() or not _NOT_LATIN.search(token):
        return (token,)
    script = _SCRIPT[np.searchsorted(_STARTS, np.frombuffer(token.encode("utf-32-le"), np.uint32), side="right") - 1]
    cuts, last, count = [0], -1, 0
    for i, c in enumerate(token):
        if not c.isalpha():
            continue
        now = int(script[i])
        if last >= 0 and (now != last and not (_UNSPACED[now] and _UNSPACED[last]) or _UNSPACED[now] and count >= PIECE):
            cuts.append(i)
            count = 0
        last, count = now, count + 1
    return tuple(token[a:b] for a, b in zip(cuts, [*cuts[1:], len(token)], strict=True))


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word's first letter; -1 without a letter."""
    first = np.array([ord(w.lstrip()[:1] or "\0") for w in words], np.int64)
    return np.where(first > 0, _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1], -1)


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray  # log chance of a gram, [bucket, language]
    script_ok: np.ndarray  # [script, language]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log odds of each language for each word (letters only): 0 for the best, FLOOR at least, BARRED if the script bars it."""
        out = np.zeros((len(words), len(self.names)), np.float32)
        if not words or not self.names:
            return out
        keys, owners = grams(words)
        for k in range(len(self.names)):
            out[:, k] = np.bincount(owners, self.table[keys, k], len(words))
        out *= 0.5  # grams overlap
        script = scripts(words)
        allowed = np.where((script >= 0)[:, None], self.script_ok[script], True)
        allowed |= ~allowed.any(axis=1, keepdims=True)
        out[~allowed] = -np.inf
        return np.where(allowed, np.maximum(out - out.max(axis=1, keepdims=True), FLOOR), BARRED).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word of texts laid end to end, where each change within a text costs ``switch``.

    All texts advance together, a word at a time; those that have ended drop out."""
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    moved = np.zeros((n, k), bool)  # whether the best path to here changed language
    came = np.zeros(n, np.int16)  # and from which
    best = np.zeros((len(lengths), k), np.float32)
    most = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(most), side="left")  # texts longer than t
    for t in range(most):
        m = active[t]
        at = starts[:m] + t
        b = best[:m]
        if t:
            top = b.argmax(axis=1)
            jump = b[np.arange(m), top][:, None] - switch
            change = jump > b
            moved[at], came[at] = change, top
            b = np.where(change, jump, b)
        best[:m] = b + scores[at]
    out = np.zeros(n, np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(most - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        now = state[:m]
        out[at] = now
        state[:m] = np.where(moved[at, now], came[at], now)
    return out


def _by_word(labels: np.ndarray, letters: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The label of most letters of each word, from those of its pieces."""
    sizes = np.array(sizes)
    first = np.cumsum(sizes) - sizes
    out = labels[first]
    for i in np.flatnonzero(sizes > 1).tolist():
        a, b = first[i], first[i] + sizes[i]
        out[i] = np.bincount(labels[a:b], letters[a:b]).argmax()
    return out


class Labeller:
    """Labels the words of texts; remembers words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.names)), np.float32)
        self.letters = np.zeros(1 << 12, np.int64)

    def _learn(self, new: list[str]) -> None:
        most = max(10_000, min(150_000, MEMORY_BYTES // (4 * self.scores.shape[1] + 200)))
        if len(self.known) + len(new) > most and self.known:
            raise MemoryError
        plain = [letters_of(w) for w in new]
        a, b = len(self.known), len(self.known) + len(new)
        if b > len(self.letters):
            self.scores = np.resize(self.scores, (2 * b, self.scores.shape[1]))
            self.letters = np.resize(self.letters, 2 * b)
        self.letters[a:b] = [sum(map(len, p.split())) for p in plain]
        self.scores[a:b] = self.model.word_scores(plain)
        self.scores[a:b][self.letters[a:b] == 0] = 0
        self.known.update(zip(new, range(a, b), strict=True))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of letters in it, spans (first word, words, language)) of each text.

        Words in more than one script, and those without spaces, are labelled in pieces; in spans such a word counts
        for the language of most of its letters."""
        whole = [(t or "").split() for t in texts]
        new = set().union(*whole).difference(self.known)
        cut = {w: p for w in new if len(p := pieces_of(w)) > 1}
        words = [[p for w in ws for p in cut.get(w, (w,))] for ws in whole] if cut else whole
        new = list(new.difference(cut).union(*cut.values()).difference(self.known))
        try:
            self._learn(new)
        except MemoryError:
            self._forget()
            self._learn(list(set().union(*words)))
        lengths = np.array([len(w) for w in words])
        at = np.fromiter((self.known[w] for ws in words for w in ws), np.int64, int(lengths.sum()))
        labels = viterbi(self.scores[at], lengths, SWITCH) if self.model.names else at
        letters = self.letters[at]
        names, out, end = self.model.names, [], 0
        for ws, n in zip(whole, lengths.tolist(), strict=True):
            some, count = labels[end : end + n], letters[end : end + n]
            end += n
            total = int(count.sum())
            if not total or not names:
                out.append((UNKNOWN, 0.0, []))
                continue
            by = np.bincount(some, count, len(names))
            best = int(by.argmax())
            if n > len(ws):
                some = _by_word(some, count, [len(cut.get(w, (w,))) for w in ws])
            cuts = [0, *(np.flatnonzero(np.diff(some)) + 1).tolist(), len(ws)]
            spans = [(a, b - a, names[some[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
            out.append((names[best], float(by[best] / total), spans))
        return out


def in_training(id_col: str) -> Column:
    """Whether a row may be learned from: crc32 of its id as text, modulo 3, isn't 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = TRAIN_DOCS) -> LanguageModel:
    """The model, from about ``sample`` whole labelled texts of each language, of those that ``in_training`` names.

    Labels are the non-null values of ``lang_col``; counts come from tasks as sums by gram and language."""
    rows = docs.where(in_training(id_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(1 << 40)).alias("h"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, int((1 << 40) * min(1.0, sample / sizes[n])) + 1)])
    rows = rows.where(F.col("h") < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((BUCKETS + len(_NAMES), len(names)), np.int64)
        for batch in chunks(batches, "text", 3 << 20):
            words: dict[str, Counter] = {}
            for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
            for lang, found in words.items():
                pairs = [(letters_of(p), c) for w, c in found.items() for p in pieces_of(w)]
                plain, n, k = [p for p, _ in pairs], np.array([c for _, c in pairs]), names.index(lang)
                keys, owners = grams(plain)
                table[:BUCKETS, k] += np.bincount(keys, n[owners], BUCKETS).astype(np.int64)
                script = scripts(plain)
                table[BUCKETS:, k] += np.bincount(script[script >= 0], n[script >= 0], len(_NAMES)).astype(np.int64)
        cell = np.flatnonzero(table.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(table.ravel()[cell])], names=["cell", "n"])

    table = np.zeros((BUCKETS + len(_NAMES)) * len(names))
    found = rows.select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    table = table.reshape(-1, len(names))
    gram, script = table[:BUCKETS], table[BUCKETS:]
    logs = np.log((gram + 0.3) / (gram.sum(axis=0) + 0.3 * BUCKETS)).astype(np.float32)
    return LanguageModel(names, logs, script >= SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1))


SPANS = "array<struct<first_word:int,n_words:int,lang:string>>"


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred string, score double, spans), a row per row of ``docs``.

    ``lang_pred``: the language of most letters of the whole text; ``score``: its share of the letters; ``spans``:
    runs of words of one language (first word from 0, number of words). Null texts and texts without a letter
    give ``und``, score 0 and no spans, as does everything if no language was learned; ties go to the first
    language by name. Null ids and repeated rows stay rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in chunks(batches, "text", 3 << 20):
            found = labeller.label(column(batch, "text").to_pylist())
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
            spans = pa.array([[{"first_word": a, "n_words": n, "lang": lang} for a, n, lang in f[2]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], names=["id", "lang_pred", "score", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id long, lang_pred string, score double, spans {SPANS}").withColumnRenamed("id", id_col)


def select_single(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that have letters, over ``least`` of them in one language.

    Null texts and texts without a letter go. Repeated rows and null ids stay or go by their texts alone; columns keep
    their names and values, whatever they are called; an empty table gives an empty table."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in chunks(batches, text_col, 3 << 20):
            found = labeller.label(column(batch, text_col).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and share > least for lang, share, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, n_spans): ``fit`` and ``identify`` over the same table.

    Nulls, empty texts, ties, repeated rows and other columns as in ``identify``; a null id isn't held out, and an empty
    table gives an empty table."""
    found = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    held = F.coalesce(~in_training(id_col), F.lit(False)).alias("held_out")
    return found.select(id_col, held, "lang_pred", "score", F.size("spans").alias("n_spans"))
