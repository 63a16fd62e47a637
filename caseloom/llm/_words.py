"""Words of whole texts as 64-bit hashes, in numpy: no Python object per word.

A word is a run without white space (see ``SPACE_CODES``); A-Z are lower-cased. A word's hash is a polynomial over
its bytes modulo 2^64, taken from running sums over the slice and mixed afterwards, so each byte is touched once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._common import SPACE_CODES

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_CODES)] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (multiply and shift, twice)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers, from 0 to n at least."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        step, back = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        step[0] = back[0] = 1
        _powers = (np.multiply.accumulate(step), np.multiply.accumulate(back))
    return _powers


@dataclass
class Words:
    """Words of successive texts; first[i]:first[i + 1] are those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return mix((self.sums[ends] - self.sums[self.starts]) * _powers_to(len(self.sums))[1][self.starts])


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]; no word spans two texts."""
    n = len(data)
    inside = ~_IS_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * _powers_to(n)[0][:n], out=sums[1:])
    return Words(starts, ends, np.searchsorted(starts, offsets), sums)
