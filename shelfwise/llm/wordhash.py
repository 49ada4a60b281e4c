"""Vectorised word and shingle hashes of a whole text (numpy, one pass)."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PLAIN = np.ones(256, bool)  # everything that is not an ASCII letter, digit or a byte of a longer character
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def lower(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return _LOWER[np.frombuffer((text or "").encode(), np.uint8)]


def words(data: np.ndarray, gaps: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    edge = np.diff(np.concatenate(([True], gaps[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length: a polynomial over the bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    data, start, size = data[start[0]:], start - start[0], end - start
    reach = np.diff(np.r_[start, len(data)])  # a word and the gap after it
    at = np.arange(len(data), dtype=np.int64) - np.repeat(start, reach)
    inside = at < np.repeat(size, reach)
    power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * power[np.where(inside, at, 0)], np.uint64(0))
    return mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _STEP)


def shingle_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words."""
    n = len(w) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h + w[i:i + n]) * _STEP
        h ^= h >> np.uint64(29)
    return mix(h)
