"""Word hashes of whole texts, vectorised over a text's bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _POWERS[i] = np.multiply.accumulate(full)
    return _POWERS[0][:n], _POWERS[1][:n]


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than blank and 0x09 to 0x0D."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of a sequence of values, which doesn't depend on where the span stands."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str, fold: bool = True) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = spans(data)
    return hashed(_VALUE[_FOLD[data] if fold else data], starts, ends)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of the whole sequence, if it is shorter; none without words."""
    if not len(words):
        return words
    m = min(n, len(words))
    out = np.zeros(len(words) - m + 1, np.uint64)
    for i in range(m):
        out = out * _BASE + words[i : len(words) - m + 1 + i]
    return np.unique(mixed(out + np.uint64(m)))


_CLASS = np.full(256, 3, np.uint8)  # letters beyond ASCII count as lower case
_CLASS[:128] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[97:123] = 3
for _i, _c in enumerate(c for c in range(33, 127) if not _CLASS[c]):
    _CLASS[_c] = 4 + _i


def shape_hashes(text: str) -> np.ndarray:
    """A hash of each word's shape: its classes of characters, punctuation marks as themselves, repeats as one."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind = _CLASS[data]
    new = np.r_[True, kind[1:] != kind[:-1]]
    new[starts] = True
    place = np.r_[0, np.cumsum(new)]
    return hashed(_VALUE[kind[new]], place[starts], place[ends])
