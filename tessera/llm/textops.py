"""Vectorised words, hashes and n-grams over the bytes of many texts at once (numpy, no loop over words).

Words are ``[^\\x20\\x09-\\x0D]+``. White space of this kind is one byte in UTF-8 and never part of a longer
character, so words can be found on bytes. A word's hash is a polynomial over random byte values modulo 2**64,
finished by a bit mixer; n-grams mix the hashes of their words. All are functions of the content alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_random = np.random.Generator(np.random.PCG64(20_240_607))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


class Words(NamedTuple):
    """first: index of each text's first word, and the number of words; start, end: byte positions; hash: of each word."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 256), _BASE, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of texts whose bytes are raw[offsets[i]:offsets[i + 1]]; lower folds A-Z before hashing."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), none, none, np.zeros(0, np.uint64))
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = solid[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] = solid[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(first, start, end, np.zeros(0, np.uint64))
    values = _BYTE[_LOWER] if lower else _BYTE
    length = end - start
    inside = np.arange(n, dtype=np.int64)
    inside[start[0] :] -= np.repeat(start, np.diff(start, append=n))
    inside[~solid] = 0
    weighted = values[raw] * _power(int(length.max()))[inside]
    weighted[~solid] = 0
    h = np.add.reduceat(weighted, start) + length.astype(np.uint64)
    return Words(first, start, end, mix(h))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words that follow one another, at the index of their first; texts' borders are not looked at."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = h[:m] * _STEP[0]
    for j in range(1, n):
        total += h[j : j + m] * _STEP[j]
    return mix(total)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For each index that ngrams(h, n) has: whether the n words belong to one text."""
    m = int(first[-1]) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[:m]
    return np.arange(m) + n <= last


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
