"""Words of many texts at once: where they stand and a 64-bit hash of each, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np

from millrace.llm.frames import flat_texts, slices

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)

# ASCII letters and digits and every byte of a code point outside ASCII.
WORD_BYTES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
# Anything but ASCII white space.
INK_BYTES = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)

SLICE_BYTES = 1 << 20


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of texts ``first .. first + len(counts)`` of a batch, in order."""

    first: int
    counts: np.ndarray  # words of each text
    hashes: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Each word's text, counted from ``first``."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def position(self) -> np.ndarray:
        """Each word's place in its text."""
        before = np.cumsum(self.counts) - self.counts
        return np.arange(len(self.hashes)) - np.repeat(before, self.counts)


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTES):
    """First byte and end of every word, and the number of words of each text."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its text
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.diff(np.searchsorted(starts, offsets))


def hashed(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of ``part`` in every range, A-Z lower-cased."""
    size = 1 << max(10, int(len(part)).bit_length())
    total = np.concatenate(([np.uint64(0)], np.cumsum(_LOWER[part] * _powers(_BASE, size)[: len(part)])))
    return mixed((total[ends] - total[starts]) * _powers(_INVERSE, size)[starts])


def scan(column, kind: np.ndarray = WORD_BYTES) -> Iterator[Words]:
    """Words of an Arrow text column, A-Z lower-cased, about a megabyte of whole texts at a time."""
    data, offsets = flat_texts(column)
    for first, last in slices(offsets, SLICE_BYTES):
        part = data[offsets[first] : offsets[last]]
        starts, ends, counts = spans(part, offsets[first : last + 1] - offsets[first], kind)
        yield Words(first, counts, hashed(part, starts, ends))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each word on (fewer words: none)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(_BASE) + hashes[k : k + m])
    return out


def pairs(hashes: np.ndarray, step: int) -> np.ndarray:
    """A hash of each word and the one ``step`` words on, the same for every step."""
    return mixed(hashes[:-step] * np.uint64(_BASE) + hashes[step:])


class _Symbols(dict):
    """Word -> number, counted up from ``first``."""

    def __init__(self, first: int):
        self.first = first

    def __missing__(self, word: bytes) -> int:
        self[word] = k = self.first + len(self)
        return k


def symbols(texts: list[list[bytes]]) -> np.ndarray:
    """A number for every word of lists of words, the same for equal words of one list and no others."""
    used, parts = 0, []
    for words in texts:
        known = _Symbols(used)
        parts.append(list(map(known.__getitem__, words)))
        used += len(known)
    return np.fromiter(chain.from_iterable(parts), np.int64, sum(map(len, parts)))


def groups(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts of at most ``limit`` bytes together; a longer one is alone."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > limit:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group
