"""Prefix-free parsing of byte strings: rolling-hash triggers cut a text into phrases.

A window is `WINDOW` bytes. Among the hashes of the TRIGGER-byte strings in a window, the least (the first of equals)
is its trigger. The windows of one trigger form a run, and their bytes together are a phrase: what a phrase is
depends on its bytes alone, so equal windows have equal triggers at equal places, wherever they are.
"""

from __future__ import annotations

import numpy as np

WINDOW, TRIGGER = 100, 24
SPAN = WINDOW - TRIGGER + 1
#: Windows of a text handled at once; phrases end there, too.
BLOCK = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


class RollingHash:
    """Hashes of any substring of data from sums of prefixes; two bases give independent hashes."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    bytes_: np.ndarray = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)

    def __init__(self, data: np.ndarray, which: int):
        n = len(data) + 1
        if which not in self.powers or len(self.powers[which][0]) < n:
            base = _BASES[which]
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                up, down = np.full(size, base), np.full(size, inverse)
                up[0] = down[0] = 1
                np.multiply.accumulate(up, out=up)
                np.multiply.accumulate(down, out=down)
            self.powers[which] = (up, down)
        up, self.down = self.powers[which]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.bytes_[data] * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= _MULTIPLIER
        h ^= h >> np.uint64(29)
        return h

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of all substrings of that length."""
        n = len(self.sums) - length
        h = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= _MULTIPLIER
        h ^= h >> np.uint64(29)
        return h


def triggers_of(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of span hashes, the place of the least (the first of equals)."""
    place = np.arange(len(h), dtype=np.int32)
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(h[b] < h[a], b, a)
        width += step
    return place


def phrases(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, phrase, first window, windows, trigger): hashes of each trigger and phrase, and where they are, in order."""
    data = np.frombuffer(text, np.uint8)
    parts = []
    for a in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
        own = data[a : a + BLOCK + WINDOW - 1]
        h, wide = RollingHash(own, 0), RollingHash(own, 1)
        grams = h.all_of(TRIGGER)
        trigger = triggers_of(grams, SPAN)
        first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        n = np.diff(np.append(first, len(trigger)))
        t = trigger[first]
        phrase = wide.of(first, first + n + WINDOW - 1) + (t - first).astype(np.uint64) * _MULTIPLIER
        parts.append((grams[t], phrase, first + a, n, t + a))
    if not parts:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e, e, e
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
