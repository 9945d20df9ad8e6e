"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Most bytes of text that a step looks at at once, however long the rows of an Arrow batch are.
CHUNK_BYTES = 8 << 20


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a worker keeps from one task to the next; it keeps one operator's only."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES, uses: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of the column ``text``, or one row.

    Workers live on for other operators' tasks: what ``kept`` has under another key than ``uses`` goes first, and
    afterwards goes what Arrow holds in reserve."""
    if uses not in _KEPT:
        _KEPT.clear()
    try:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            start = total = 0
            for i, n in enumerate(sizes):
                if total and total + n > most:
                    yield batch.slice(start, i - start)
                    start, total = i, 0
                total += n
            if len(sizes) > start:
                yield batch.slice(start)
    finally:
        pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
