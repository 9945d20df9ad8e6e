"""Defaults of the library in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    min_frequency: int = 3
    min_length: int = 3
    max_patterns: int = 262
    threshold: float = 0.01
    min_characters: int = 250
    min_strip_length: int = 3
    ngram_lengths: tuple[int, ...] = (8, 16, 32)
    repetition: float = 0.1
    min_prompt: int = 100
    structural_hits: int = 20


DEFAULTS = Options()
