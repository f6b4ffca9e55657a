"""Words of whole Arrow columns at once: their bytes, their rows and 64-bit hashes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from trajspark.llm.common import offsets_of

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII characters but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, _INVERSE)):
            row = np.full(n, x, np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words in order. rows: of how many texts; row: of each word its text; start, end: its bytes in `data`."""
    rows: int
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    total: np.ndarray

    def prefix(self, size: int) -> np.ndarray:
        """Hashes of the first `size` bytes of each word; 0 where the word has no more than that."""
        long = self.end - self.start > size
        at = np.where(long, self.start + size, self.start)
        part = (self.total[at] - self.total[self.start]) * powers(len(self.data))[1][self.start]
        return np.where(long, mix(part + U(size)), U(0))

    def first(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def words_of(column: pa.Array, apart: np.ndarray = SPACE, fold: bool = True, cuts=None) -> Words:
    """Maximal runs of bytes that `apart` doesn't hold; none crosses two texts. fold: A-Z to lower case.

    cuts: a function of the bytes that says before which of them a word ends as well.
    """
    at, data = offsets_of(column)
    if fold:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(len(at) - 1, data, none, none, none, np.zeros(0, np.uint64), np.zeros(1, np.uint64))
    inside = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    if cuts is not None:
        edge[:-1] |= cuts(data)
    before = np.empty(n + 1, bool)
    before[1:] = ~inside
    before[0] = True
    after = np.empty(n, bool)
    after[:-1] = ~inside[1:]
    after[-1] = True
    start = np.flatnonzero(inside & (before[:-1] | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + U(1)) * up, out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    row = np.searchsorted(at, start, "right") - 1
    return Words(len(at) - 1, data, row, start, end, hashed, total)
