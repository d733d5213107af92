"""Words and their hashes, for all texts of a slice of rows at once, on arrays of bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: One odd factor for each place in a shingle.
PLACES = np.array([(0xBF58476D1CE4E5B9 * (2 * i + 3) ^ 0x94D049BB133111EB) | 1 for i in range(64)], dtype=object)
PLACES = np.array([int(x) & (2**64 - 1) for x in PLACES], np.uint64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input reaches each bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=1)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below `length`."""
    inverse = pow(BASE, -1, 2**64)
    out = []
    for base in (BASE, inverse):
        p = np.full(length, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 16, 1 << max(0, length - 1).bit_length()))


def words(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are not white space."""
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none, none
    white = WHITE[flat]
    filled = bounds[:-1] < bounds[1:]
    first = np.empty(len(flat), bool)
    first[0], first[1:] = True, white[:-1]
    first[bounds[:-1][filled]] = True
    last = np.empty(len(flat), bool)
    last[-1], last[:-1] = True, white[1:]
    last[bounds[1:][filled] - 1] = True
    starts, ends = np.flatnonzero(first & ~white), np.flatnonzero(last & ~white) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(flat))
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[flat] * up[: len(flat)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `size` words of one row; a row with fewer words is one shingle."""
    n_words = np.bincount(row, minlength=rows)
    first = np.cumsum(n_words) - n_words
    n = len(hashes)
    runs = max(0, n - size + 1)
    total = np.zeros(runs, np.uint64)
    for place in range(size):
        total += hashes[place : place + runs] * PLACES[place]
    whole = row[:runs] == row[size - 1 : size - 1 + runs] if runs else np.zeros(0, bool)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    extra = np.zeros(len(short), np.uint64)
    for place in range(size - 1):
        has = n_words[short] > place
        extra[has] += hashes[first[short[has]] + place] * PLACES[place]
    extra += n_words[short].astype(np.uint64) * PLACES[size]
    return np.concatenate([row[:runs][whole], short]), mix(np.concatenate([total[whole], extra]))


def distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, in order."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]
