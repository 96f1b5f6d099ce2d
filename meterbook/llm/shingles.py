"""Hashed word shingles of texts, in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    _INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the hash base and of its inverse modulo 2^64."""
    size = CHUNK_BYTES + 1024 if n <= CHUNK_BYTES + 1024 else n
    if size not in _powers:
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > CHUNK_BYTES + 1024:       # only for a very long word; not kept
            return made[0], made[1]
        _powers[size] = (made[0], made[1])
    return _powers[size]


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of every word of lower-cased bytes, in order."""
    found = []
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r" and data[end - 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            up, down = powers(len(raw))
            total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[:len(raw)])])
            found.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes: of five words each, or one of the whole text if it has fewer."""
    if not text:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        w = word_hashes(text.encode().lower())
        n = len(w)
        if not n:
            return w
        width = min(n, WORDS)
        total = w[:n - width + 1].copy()
        for k in range(1, width):
            total *= _STEP
            total += w[k:n - width + 1 + k]
        if width < WORDS:
            total += np.uint64(width) * _BASE
        return np.unique(mix(total))
