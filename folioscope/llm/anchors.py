"""Anchors: each window of ``length`` bytes is owned by one place in it, chosen by content, so equal windows have equal owners."""

from __future__ import annotations

import numpy as np

GRAM = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = 22  # bits of a place within a segment
SEGMENT = (1 << _PLACE) - 4096


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` (a power of two, 8 or more) bytes from each place on; grams are joined by halves."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.ndarray((len(data) - 7,), np.uint64, np.frombuffer(data, np.uint8), 0, (1,)).copy()
    size = 8
    while True:
        h ^= h >> np.uint64(31)
        h *= _A
        if size >= gram:
            return h
        h = h[:-size] + (h[size:] ^ (h[size:] >> np.uint64(33))) * _B
        size *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of ``width``, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def owned(data: bytes, length: int, gram: int = GRAM, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, place, hash): windows starting at first to last are owned by the gram at place.

    The owner is the leftmost gram of least hash within the window. Long texts are worked through in segments; a window
    lies in one of them whole, so its owner is the same.
    """
    out = []
    for base in range(0, max(1, len(data) - length + 1), segment):
        part = data[base : base + segment + length - 1]
        if len(part) < length:
            continue
        h = gram_hashes(part, gram)
        keyed = h & ~np.uint64((1 << _PLACE) - 1)
        keyed |= np.arange(len(h), dtype=np.uint64)
        owner = (_least(keyed, length - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(owner) - 1]])
        place = owner[first]
        out.append((first + base, last + base, place + base, h[place]))
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
