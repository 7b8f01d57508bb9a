"""Cutting texts into runs of fixed-length windows that share a minimizer, so that equal windows meet in one bucket."""

from __future__ import annotations

import numpy as np

#: Bytes of a window, of a minimizer, and minimizer places in a window.
WIDTH, K = 50, 16
PLACES = WIDTH - K + 1
#: Longest run of windows.
MOST_WINDOWS = 64
#: Added to the place of a minimizer whose value stands again inside its run.
MANY = 64

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_BASE = 0x5851F42D4C957F2D
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def words64(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one integer; ``data`` must have 8 bytes of padding."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


class SpanHash:
    """64-bit polynomial hashes of any byte range of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start] ^ ((end - start).astype(np.uint64) * _C)


def mix(x: np.ndarray) -> np.ndarray:
    """The 32-bit value by which K bytes, folded into ``x``, compete for being a minimizer."""
    x = x ^ (x >> np.uint64(29))
    x *= _C
    return (x >> np.uint64(32)).astype(np.uint32)


def runs(data: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end of windows, minimizer value, minimizer place in the first window) of every run.

    ``data``: the texts laid end to end, padded with 8 bytes. A run's windows have the same least minimizer value, a
    function of a window's own bytes. ``MANY`` is added to the place if the value occurs again inside the run.
    """
    n = len(data) - 8
    w = words64(data)
    value = mix((w[: n - K + 1] * _A) ^ (w[8 : n - K + 9] * _B))
    least, have = value, 1
    while have * 2 <= PLACES:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < PLACES:
        least = np.minimum(least[: len(least) - (PLACES - have)], least[PLACES - have :])
    change = np.zeros(len(least) + 1, np.int8)
    ok = doc_end - doc_start >= WIDTH
    s, e = doc_start[ok], doc_end[ok] - WIDTH + 1
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, s, 1)
    np.add.at(valid, e, -1)
    valid = np.cumsum(valid, dtype=np.int8)
    change[s], change[e] = 1, 1
    change[1 : len(least)] |= least[1:] != least[:-1]
    cut = np.flatnonzero(change)
    first, end = cut[:-1], cut[1:]
    inside = valid[first] > 0
    first, end = first[inside], end[inside]
    if len(first) and (end - first).max() > MOST_WINDOWS:
        pieces = -(-(end - first) // MOST_WINDOWS)
        which = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, end = np.repeat(first, pieces) + which * MOST_WINDOWS, np.repeat(end, pieces)
        end = np.minimum(end, first + MOST_WINDOWS)
    low = least[first]
    place = np.full(len(first), -1, np.int64)
    todo = np.arange(len(first))
    for off in range(PLACES):
        hit = value[first[todo] + off] == low[todo]
        place[todo[hit]] = off
        todo = todo[~hit]
        if not len(todo):
            break
    place[end - 1 > first + place] += MANY
    return first, end, low, place
