"""Token ids of a corpus in binary files: a concatenated id array with Elias-Fano document boundaries.

A file holds consecutive documents, in ascending order of their ids:

    4 bytes   "LXTK"
    u8        bytes of a token id: 2 if the vocabulary has at most 65,536 ids, else 4
    u64       documents
    u64       of these, how many have no id (they come first)
    i64       the smallest document id
    Elias-Fano: boundaries of the documents in the id array, documents + 1 values from 0
    Elias-Fano: document ids less the smallest
    the token ids, little-endian
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column, kept
from lexipress.llm.elias_fano import EliasFano
from lexipress.llm.units import UnitMemory, independent_units
from lexipress.storage import settle

MAGIC = b"LXTK"
_HEAD = struct.Struct("<4sBQQq")
#: A file is closed when it has this many token ids.
FILE_TOKENS = 4 << 20
#: Texts that go to the library at once, and bytes of text that a task looks at at once.
ENCODE_ROWS, CHUNK = 8192, 3 << 20
#: Bytes of each of the two generations of remembered units.
MEMORY_BYTES = 96 << 20
#: Documents whose boundaries are read from a file at once.
WINDOW_DOCS = 4096
#: A table of files with at most this many rows is broadcast.
BROADCAST_FILES = 100_000


class TokenFile:
    """One file's documents, read from its bytes without copying."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, self.n_docs, self.n_null, self.first_id = _HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.bounds, used = EliasFano.from_buffer(view[at:])
        at += used
        self.doc_ids, used = EliasFano.from_buffer(view[at:])
        self.ids = np.frombuffer(view, f"<u{width}", offset=at + used)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first_id + self.doc_ids[i - self.n_null]

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The bytes of a file. ids: each document's, as little-endian unsigned integers of ``width`` bytes."""
    n_null = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[n_null:], np.int64)
    first = int(known[0]) if len(known) else 0
    bounds = np.concatenate(([0], np.cumsum([len(x) // width for x in ids], dtype=np.int64)))
    offsets = (known.astype(np.uint64) - np.uint64(first % (1 << 64))) if len(known) else known
    head = _HEAD.pack(MAGIC, width, len(doc_ids), n_null, first)
    return b"".join([head, EliasFano.of(bounds).to_bytes(), EliasFano.of(offsets).to_bytes(), *ids])


def byte_alphabet() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class TokenEncoder:
    """The tokenizers library over the distinct independent units of many texts.

    Strings of special tokens are ordinary text. Only a byte-level tokenizer without a normalizer and with the usual
    pattern can take a text in units; any other gets whole texts.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        said = json.loads(self.tokenizer.to_str())
        before = said.get("pre_tokenizer") or {}
        self.byte_level = not said.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.bytes_of = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.memory = UnitMemory(self._unit, MEMORY_BYTES)
        self.alphabet = byte_alphabet()
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.tokenize = self.tokenizer.model.tokenize

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), ENCODE_ROWS):
            out += [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + ENCODE_ROWS], add_special_tokens=False)]
        return out

    def _unit(self, u: str) -> bytes:
        """A unit falls into the pattern's matches; the library's model encodes each in the byte-level alphabet."""
        table = self.bytes_of
        if u.isascii():
            if u.isalpha():  # a run of letters is one match
                return b"".join([table[t.id] for t in self.tokenize(u)])
            if u[:1] == " " and u[1:].isalpha():
                return b"".join([table[t.id] for t in self.tokenize("\u0120" + u[1:])])
        parts = self.find(u)
        if len(parts) != 1:
            return b"".join([self.memory[x] for x in parts])
        return b"".join([table[t.id] for t in self.tokenize(u.encode().decode("latin-1").translate(self.alphabet))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, ``width`` bytes each."""
        if not self.byte_level:
            return self._ids(texts)
        out = []
        for text in texts:  # one text's units at a time
            self.memory.age()
            units = independent_units(text)
            out.append(self._ids([text])[0] if units is None else b"".join(map(self.memory.__getitem__, units)))
        return out


def _put(uri: str, data: bytes) -> None:
    """Writes a file under another name first, so that it is whole or absent; a repeated task puts it again."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes every whole text and writes files to ``folder`` (a URI that all nodes reach).

    Returns the manifest (part int, seq int, n_docs long, n_tokens long): files ``part-seq.tok`` in this order hold
    the documents in ascending order of id. Null texts count as empty; rows with a null id come first; rows
    with the same id stay rows, in an order that depends on their texts only. ``end_id`` is appended to each
    document. Documents are dealt out by ranges of (id, text hash), so no id can fill a task; a task holds one
    file's ids at a time.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(("token-files", tokenizer_path), lambda: TokenEncoder(tokenizer_path))
        end = b"" if end_id is None else end_id.to_bytes(coder.width, "little")
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        ids: list[bytes] = []

        def close() -> pa.RecordBatch:
            _put(f"{folder}/{part:08d}-{seq:06d}.tok", pack(names, ids, coder.width))
            row = [[part], [seq], [len(names)], [size // coder.width]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "n_docs", "n_tokens"])

        for batch in chunks(batches, "text", CHUNK, ("token-files", tokenizer_path)):
            encoded = coder.encode([t or "" for t in column(batch, "text").to_pylist()])
            for name, x in zip(column(batch, "id").to_pylist(), encoded, strict=True):
                names.append(name)
                ids.append(x + end)
                size += len(x) + len(end)
                if size >= FILE_TOKENS * coder.width:
                    yield close()
                    names, ids, size, seq = [], [], 0, seq + 1
        if names:
            yield close()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(dealt.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seq, doc_id, start_in_file, n_tokens, ids_crc32), a row per document, from the files alone.

    ``ids_crc32``: unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(column(batch, "name").to_pylist(), column(batch, "content"), strict=True):
                file = TokenFile(data.as_buffer())
                part, seq = (int(x) for x in name.removesuffix(".tok").split("-"))
                for k in range(0, file.n_docs, WINDOW_DOCS):  # select gives a window's offsets; no table of all is made
                    n = min(WINDOW_DOCS, file.n_docs - k)
                    bounds, null = file.bounds.slice(k, k + n + 1), min(max(file.n_null - k, 0), n)
                    known = file.doc_ids.slice(k + null - file.n_null, k + n - file.n_null).astype(np.uint64) + np.uint64(file.first_id % (1 << 64))
                    doc_ids = pa.concat_arrays([pa.nulls(null, pa.int64()), pa.array(known.view(np.int64))])
                    wide, cuts = memoryview(file.ids[bounds[0] : bounds[-1]].astype("<u4")).cast("B"), (4 * (bounds - bounds[0])).tolist()
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), doc_ids, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        names=["part", "seq", "doc_id", "start_in_file", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.mapInArrow(run, "part int, seq int, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")


def token_offsets(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start``: ids of all documents before it.

    Offsets of files add up in two steps (files of a part, parts), so that no task sees all files."""
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    files = manifest.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner"))
    files = settle(files.join(parts.hint("shuffle_merge"), "part").select("part", "seq", (F.col("inner") + F.col("before")).alias("base")), "token-bases")
    files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files.hint("shuffle_merge")
    docs = read_token_files(spark, folder)
    return docs.join(files, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def corpus_token_offsets(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns ``token_offsets`` read back from them; an empty table gives an empty table."""
    manifest = write_token_files(docs, folder, tokenizer_path, end_id, id_col, text_col)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    return token_offsets(docs.sparkSession, folder, manifest).withColumnRenamed("doc_id", id_col)
