"""Token counts of whole texts: pieces are counted once per distinct pre-token and joined to each document's pre-tokens."""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column, kept
from lexipress.llm.token_files import TokenEncoder
from lexipress.llm.units import UnitMemory, independent_units
from lexipress.storage import settle

#: Frequent pre-tokens that go to every task: at most so many, of at most so many bytes together. All others are joined.
FREQUENT, FREQUENT_BYTES = 100_000, 4 << 20
#: Different pre-tokens that a task gathers before it passes their counts on.
TASK_ENTRIES = 200_000
#: Bytes of text that a task looks at at once, and of each of the two generations of remembered units.
CHUNK, MEMORY_BYTES = 4 << 20, 48 << 20


class PreTokenizer:
    """Cuts texts into what a byte-level tokenizer encodes independently, as its library does by default.

    The contents of special tokens are cut out first, each one piece. What lies between falls into units at single
    spaces and these into matches of the tokenizer's pattern."""

    def __init__(self, tokenizer_path: str):
        self.coder = TokenEncoder(tokenizer_path)
        added = self.coder.tokenizer.get_added_tokens_decoder().values()
        self.plain_added = not any(t.single_word or t.lstrip or t.rstrip for t in added)
        self.special = sorted((t.content for t in added if t.content), key=lambda s: (-len(s), s))
        self.cut = re.compile("|".join(map(re.escape, self.special)) or r"(?!)").split

    def units(self, text: str) -> tuple[list[str], int]:
        """Parts of a text that can be cut further independently of each other, and its number of special tokens."""
        if not any(s in text for s in self.special):
            units = independent_units(text)
            return (self.coder.find(text) if units is None else units), 0
        parts, out = self.cut(text), []
        for part in parts:
            out += self.units(part)[0]
        return out, len(parts) - 1

    def pretokens(self, unit: str) -> list[str]:
        return self.coder.find(unit)

    def pieces(self, pretoken: str) -> int:
        return len(self.coder.tokenize(pretoken.encode().decode("latin-1").translate(self.coder.alphabet)))


def whole_text_counter(tokenizer_path: str) -> Callable[[list[str]], list[int]]:
    """Counts by the tokenizer's own library: sentencepiece for .model, tokenizers for .json; no begin, end or added special
    tokens, no truncation or padding."""
    if tokenizer_path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _splitter(tokenizer_path: str) -> PreTokenizer | None:
    """None for a tokenizer whose pre-tokens can't be counted apart from each other by this module."""
    if not tokenizer_path.endswith(".json"):
        return None
    found = PreTokenizer(tokenizer_path)
    return found if found.coder.byte_level and found.plain_added else None


def pretoken_counts(texts: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, n, pieces), a row per distinct pre-token of the corpus; each is encoded once.

    Tasks pass on counts of what they have seen, so the most frequent pre-tokens are a row a task in the shuffle."""
    key = ("token-counts", tokenizer_path)

    def rows(seen: Counter, units: Counter, cutter: PreTokenizer) -> pa.RecordBatch:
        for unit, n in units.items():
            for p in cutter.pretokens(unit):
                seen[p] += n
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "n"])
        seen.clear()
        units.clear()
        return out

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = kept(key, lambda: PreTokenizer(tokenizer_path))
        seen, units = Counter(), Counter()
        for batch in chunks(batches, "text", CHUNK, key):
            for text in column(batch, "text").to_pylist():
                units.update(cutter.units(text or "")[0])
                if len(units) >= TASK_ENTRIES:
                    yield rows(seen, units, cutter)
        if units:
            yield rows(seen, units, cutter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = kept(key, lambda: PreTokenizer(tokenizer_path))
        for batch in chunks(batches, "pretoken", CHUNK, key):
            pieces = [cutter.pieces(p) for p in column(batch, "pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "pretoken"), column(batch, "n"), pa.array(pieces, pa.int64())], names=["pretoken", "n", "pieces"])

    seen = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(gather, "pretoken string, n long")
    return seen.groupBy("pretoken").agg(F.sum("n").alias("n")).mapInArrow(count, "pretoken string, n long, pieces long")


def _frequent_from(pretokens: DataFrame) -> int:
    """The least count from which on pre-tokens are few and short enough for every task (FREQUENT, FREQUENT_BYTES)."""
    size = pretokens.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("level")).agg(F.min("n").alias("least"), F.count("*").alias("k"), F.sum(F.octet_length("pretoken")).alias("bytes"))
    least, k, total = (1 << 63) - 1, 0, 0
    for r in sorted(size.collect(), key=lambda r: -r["level"]):  # at most 505 rows
        k, total = k + r["k"], total + r["bytes"]
        if k > FREQUENT or total > FREQUENT_BYTES:
            break
        least = r["least"]
    return least


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), a row per row of ``docs``: bytes of the text in UTF-8, tokens as the tokenizer's
    library counts them by default (contents of special tokens inside texts are one token each; nothing is added,
    truncated or padded), and whether there are more than ``limit``.

    Each distinct pre-token of the corpus is encoded once (``pretoken_counts``). Counts of the most frequent ones go to
    tasks within fixed bounds and are summed there over the document's frequencies; the document's other pre-tokens leave
    the task with their frequencies, meet their counts in a join, and are summed per row. No ids are made for documents.

    Null texts count as empty: 0 bytes, 0 tokens. Null and repeated ids are rows like others, very long texts are counted
    whole, other columns are ignored whatever their names, and an empty table gives an empty table. Tokenizers that
    aren't byte-level, and sentencepiece models, have no pre-tokens to be counted apart: their library counts texts.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    final = lambda rows: rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    if _splitter(tokenizer_path) is None:

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = kept(("whole-counts", tokenizer_path), lambda: whole_text_counter(tokenizer_path))
            for batch in chunks(batches, "text", CHUNK, ("whole-counts", tokenizer_path)):
                text = column(batch, "text")
                sizes = pa.compute.binary_length(text).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([column(batch, "id"), sizes, pa.array(count(text.to_pylist()), pa.int64())], names=["id", "n_bytes", "n_tokens"])

        return final(source.mapInArrow(plain, f"id {kind}, n_bytes long, n_tokens long"))

    pretokens = settle(pretoken_counts(source, tokenizer_path), "pretokens")
    least = _frequent_from(pretokens)
    frequent = {r.pretoken: r.pieces for r in pretokens.where(F.col("n") >= least).collect()}  # within FREQUENT and FREQUENT_BYTES
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    key = ("frequent-counts", uuid.uuid4().hex)  # this call's own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            cutter, known = PreTokenizer(tokenizer_path), sent.value

            def split(unit: str) -> tuple[int, tuple[str, ...]]:
                parts = cutter.pretokens(unit)
                return sum(known.get(p, 0) for p in parts), tuple(p for p in parts if p not in known)

            return cutter, UnitMemory(split, MEMORY_BYTES)

        cutter, memory = kept(key, make)
        for batch in chunks(batches, "text", CHUNK, key):
            sums, names, times = [], [], []
            for text in column(batch, "text").to_pylist():
                memory.age()
                units, total = cutter.units(text)
                rare: Counter = Counter()
                for unit, n in Counter(units).items():
                    some, others = memory[unit]
                    total += n * some
                    for p in others:
                        rare[p] += n
                sums.append(total)
                names.append(list(rare))
                times.append(list(rare.values()))
            sizes = pa.compute.binary_length(column(batch, "text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), sizes, pa.array(sums, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], names=["id", "n_bytes", "known", "pretokens", "times"])

    summed = source.mapInArrow(run, f"id {kind}, n_bytes long, known long, pretokens array<string>, times array<long>")
    summed = settle(summed.withColumn("row", F.monotonically_increasing_id()), "known-counts")
    rare = summed.select("row", F.inline(F.arrays_zip(F.col("pretokens").alias("pretoken"), F.col("times").alias("k"))))
    rest = pretokens.where(F.col("n") < least).select("pretoken", "pieces")
    added = rare.join(rest.hint("shuffle_merge"), "pretoken").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("more"))
    both = summed.select("id", "row", "n_bytes", "known").join(added.hint("shuffle_merge"), "row", "left")
    return final(both.withColumn("n_tokens", F.col("known") + F.coalesce("more", F.lit(0).cast("long"))))
