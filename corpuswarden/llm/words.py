"""Words of whole batches of texts as arrays: places and 64-bit hashes, without a Python object for each."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a one-to-one map of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

KEPT_POWERS = 1 << 21  # those of longer batches are computed anew each time, and freed
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) > n:
        return _powers[0][: n + 1], _powers[1][: n + 1]
    out = []
    for base in (_MULTIPLIER, _INVERSE):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    if n <= KEPT_POWERS:
        _powers[:] = out
    return out[0], out[1]


def places(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run without ASCII white space; no run goes over the end of a text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[raw]
    first = np.empty(len(raw) + 1, bool)
    first[0], first[-1] = True, True
    np.logical_not(solid[:-1], out=first[1:-1])
    first[starts] = True
    begin = np.flatnonzero(solid & first[:-1])
    after = np.empty(len(raw), bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= first[1:] & solid  # the next byte begins another text
    return begin, np.flatnonzero(solid & after) + 1


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, from running sums over the whole batch."""
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
