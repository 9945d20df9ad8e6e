"""Byte-level BPE by merge replay over the distinct words of many documents, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column, kept
from lexipress.llm.units import Memory, independent_units

NO_RANK = np.int64(1) << 40
#: Bytes of text that go through the replay together, and of each of the two generations of remembered units.
CHUNK, MEMORY_BYTES = 4 << 20, 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes lists of words by applying every merge, in rank order, to all words at once.

    All words lie in one array of token ids with links to the left and right neighbour. An inverted index from
    merge rank to the positions of pairs with that rank says where a merge applies; a merge touches only these
    positions and the pairs beside them.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.table[r] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = len(self.table)
        pairs = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = r
        codes = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(codes)
        self.codes, self.merged = codes[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(left), NO_RANK)
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], NO_RANK)

    def _file(self, index: dict, heap: list, positions: np.ndarray, ranks: np.ndarray) -> None:
        keep = ranks < NO_RANK
        positions, ranks = positions[keep], ranks[keep]
        if not len(positions):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = [0, *cuts.tolist()]
        for r, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                heapq.heappush(heap, r)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Token ids of every word, as the library's own encoder gives them, each a little-endian uint32."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = np.cumsum(lengths)
        tokens = np.append(self.byte_ids[data], 0)
        right = np.arange(1, n + 2, dtype=np.int64)  # n: no neighbour
        right[ends[lengths > 0] - 1] = n
        right[n] = n
        left = np.arange(-1, n, dtype=np.int64)
        starts = ends - lengths
        left[starts[lengths > 0]] = n
        left[n] = n
        rank = np.full(n + 1, NO_RANK)
        inner = np.flatnonzero(right[:n] < n)
        rank[inner] = self._rank_of(tokens[inner], tokens[right[inner]])
        alive, mark = np.ones(n + 1, bool), np.zeros(n + 1, bool)
        index: dict[int, list] = {}
        heap: list[int] = []
        self._file(index, heap, inner, rank[inner])
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.concatenate(at)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
                mark[at] = True
                clash = mark[right[at]].any()
                mark[at] = False
                at = self._apart(at, right) if clash else at
            gone = right[at]
            after = right[gone]
            tokens[at] = r
            right[at] = after
            left[after] = at
            left[n] = n
            alive[gone] = False
            rank[gone] = NO_RANK
            before = left[at]
            touched = np.concatenate((at, before[before < n]))
            nexts = right[touched]
            new = np.where(nexts < n, self._rank_of(tokens[touched], tokens[nexts]), NO_RANK)
            if len(at) > 1 and new.min() < r:
                odd.append(touched[new < r])  # a word whose next merge has a lower rank: order within it matters
            rank[touched] = new
            self._file(index, heap, touched, new)
        alive[n] = False
        ids = tokens[alive].astype("<u4").tobytes()
        count = 4 * np.concatenate(([0], np.cumsum(alive[:n])))
        out = [ids[a:b] for a, b in zip(count[starts].tolist(), count[ends].tolist(), strict=True)]
        for w in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist() if odd else ():
            out[w] = self._alone(words[w])
        return out

    @staticmethod
    def _apart(at: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of positions that overlap their right neighbour, every second one, from the left."""
        keep, blocked = [], -1
        for p, q in zip(at.tolist(), right[at].tolist(), strict=True):
            if p != blocked:
                keep.append(p)
                blocked = q
        return np.array(keep, np.int64)

    def _alone(self, word: bytes) -> bytes:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], NO_RANK), i) for i in range(len(parts) - 1))
            if r >= NO_RANK:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return np.array([self.ranks[p] for p in parts], "<u4").tobytes()


class CorpusEncoder:
    """Encodes texts: distinct words of each chunk of documents go through the merge replay once."""

    def __init__(self, ranks_path: str, pattern: str):
        self.replay = MergeReplay(read_ranks(ranks_path))
        self.pattern = regex.compile(pattern)
        self.memory = Memory(MEMORY_BYTES)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            units = independent_units(text)
            split.append(self.pattern.findall(text) if units is None else units)
        known = self.memory.values(set().union(*split), self._units)
        return [b"".join([known[u] for u in units]) for units in split]

    def _units(self, new: list[str]) -> list[bytes]:
        """Units fall into the pattern's matches; different ones go through the replay once."""
        find = self.pattern.findall
        parts = [(u,) if u.isascii() and u.lstrip(" ").isalpha() else find(u) for u in new]  # a run of letters is one match
        words = list(set().union(*parts))
        ids = dict(zip(words, self.replay.encode([w.encode() for w in words]), strict=True))
        return [ids[part[0]] if len(part) == 1 else b"".join([ids[w] for w in part]) for part in parts]

    def decode(self, ids: bytes) -> bytes:
        table = self.replay.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens, decoded binary): every text encoded, and the ids decoded again.

    ranks_path: a rank file, present on every node. ``ids`` are little-endian unsigned 32-bit integers.
    Null and empty texts have no ids and decode to nothing; null ids of documents and repeated rows are kept as
    rows; other columns are ignored. An empty table gives an empty table. No row is shuffled: the work is one
    pass over the input, chunk by chunk, so memory does not depend on the size of a partition.
    """
    key = ("bpe", ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(key, lambda: CorpusEncoder(ranks_path, pattern))
        for batch in chunks(batches, "text", CHUNK, key):
            ids = coder.encode([t or "" for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([coder.decode(x) for x in ids], pa.binary())],
                names=["id", "ids", "n_tokens", "decoded"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, ids binary, n_tokens long, decoded binary").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``bpe_encode``, hashed in the task so that no text comes back."""
    key = ("bpe", ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(key, lambda: CorpusEncoder(ranks_path, pattern))
        for batch in chunks(batches, "text", CHUNK, key):
            ids = coder.encode([t or "" for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
