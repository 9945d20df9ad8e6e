"""Cuts a text into parts that byte-level BPE encodes independently of each other."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space that a match of the tokenizers' pattern may hold elsewhere than at its start: white space before it and
#: white space or the end after it. \\s of Python covers all of Unicode's white space.
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


def independent_units(text: str) -> list[str] | None:
    """The parts of ``text`` between single spaces, each but the first with its leading space; joined they give
    the text. No match of the pattern crosses their borders: a match holds a space only at its start or within a
    run of white space, and texts with runs that a cut could part give None (their caller takes the whole text).
    """
    if _INNER_SPACE.search(text):
        return None
    if "\0" in text:
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    return text.replace(" ", "\0 ").split("\0")


#: Bytes of each of the two generations of what a task remembers (about), and what an entry takes besides its unit and value.
MEMORY_BYTES, ENTRY_BYTES = 40 << 20, 200


class Memory:
    """Remembers what was computed for units. Two generations of a bounded size: when the young one is full it becomes
    the old one, so units that come again soon stay and rare ones go; results don't depend on it."""

    def __init__(self, most: int = MEMORY_BYTES):
        self.most, self.young, self.old, self.size = most, {}, {}, 0

    def _keep(self, units: list[str], values: list[bytes]) -> None:
        self.young.update(zip(units, values, strict=True))
        self.size += sum(map(len, units)) + sum(map(len, values)) + ENTRY_BYTES * len(units)

    def values(self, units: set[str], compute: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """Has all of ``units``, those that aren't remembered computed together; good until the next call."""
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0
        new = units.difference(self.young)
        if self.old:
            again = list(new.intersection(self.old))
            self._keep(again, [self.old[u] for u in again])
            new.difference_update(again)
        new = list(new)
        self._keep(new, compute(new))
        return self.young


class UnitMemory(dict):
    """``Memory`` that computes what it doesn't know, one unit at a time."""

    def __init__(self, compute: Callable[[str], object], most: int = MEMORY_BYTES):
        super().__init__()
        self.most, self.compute, self.old, self.size = most, compute, {}, 0

    def age(self) -> None:
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()

    def __missing__(self, unit: str) -> object:
        found = self.old.get(unit)
        if found is None:
            found = self.compute(unit)
        self[unit] = found
        self.size += len(unit) + ENTRY_BYTES
        return found
