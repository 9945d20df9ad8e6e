"""Arrow batches inside tasks, cut by bytes of text, and words of Python strings as the JVM's pattern has them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Most bytes of text whose rows become Python objects at once.
PIECE_BYTES = 4 << 20


def cuts(sizes: list[int], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of pieces of about ``most`` bytes, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i - start
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def pieces(part: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """An array of texts, or of arrays of texts, in pieces."""
    if pa.types.is_list(part.type):
        flat = pa.compute.fill_null(pa.compute.binary_length(part.flatten()), 0).cast(pa.int64())
        ends = pa.compute.cumulative_sum(flat).to_pylist()
        upto = [0, *ends]
        counts = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_pylist()
        sizes, at = [], 0
        for k in counts:
            sizes.append(upto[at + k] - upto[at])
            at += k
    else:
        sizes = pa.compute.fill_null(pa.compute.binary_length(part), 0).to_pylist()
    for start, k in cuts(sizes, most):
        yield part.slice(start, k)


def _ranges(points: list[int]) -> str:
    out: list[list[int]] = []
    for x in points:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "".join(re.escape(chr(a)) + ("" if a == b else "-" + re.escape(chr(b))) for a, b in out)


_NEWER: dict[str, list[int]] = {}


def newer_letters(spark: SparkSession) -> list[int]:
    r"""Characters that are \w for Python and not ``[\p{L}\p{N}_]`` for this session's JVM, whose Unicode is older: found by
    trying all (once an application). There are none the other way round, which is checked."""
    app = spark.sparkContext.applicationId
    if app not in _NEWER:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        every = spark.range(0x110000).where("id < 55296 or id > 57343").withColumn("c", char)  # a catalog of characters
        kinds = every.select("id", F.col("c").rlike(r"^[\p{L}\p{N}_]$").alias("word"), F.col("c").rlike(r"^\p{L}$").alias("letter")).where("id > 127 and (word or letter)").collect()
        words, letters = {r.id for r in kinds if r.word}, {r.id for r in kinds if r.letter}
        over = [x for x in range(128, 0x110000) if not 0xD800 <= x < 0xE000 and x not in words and re.match(r"\w", chr(x))]
        if any(not re.match(r"\w", chr(x)) for x in words) or any((x in letters) != chr(x).isalpha() for x in words):
            raise ValueError("Python knows fewer letters than the JVM")  # an older Unicode than Java's
        _NEWER.clear()
        _NEWER[app] = over
    return _NEWER[app]


class Words:
    """Finds a text's words (``[\\p{L}\\p{N}_]+`` of the JVM), and the pairs of words that a dot joins, read from left to right
    without sharing a word. ``newer``: see ``newer_letters``; only texts that hold one take the slower class."""

    def __init__(self, newer: list[int]):
        exact = rf"[^\W{_ranges(newer)}]"
        self.newer = set(map(chr, newer))
        self.item, self.exact = (re.compile(rf"{c}++(?:\.{c}++)?") for c in (r"\w", exact))

    def of(self, text: str) -> tuple[list[str], list[str]]:
        found = self.item.findall(text)
        if not text.isascii() and not self.newer.isdisjoint("".join([x for x in found if not x.isascii()])):
            found = self.exact.findall(text)
        pairs = [x for x in found if "." in x] if "." in text else []
        if pairs:
            found = [x for x in found if "." not in x]
            for x in pairs:
                found += x.split(".")
        return found, pairs
