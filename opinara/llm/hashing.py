"""Rolling hashes of bytes on arrays, the same on every machine."""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word; different words stay different."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(BASE))


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 2**64)
    one = np.ones(1, dtype=U)
    return tuple(np.concatenate((one, np.cumprod(np.full(size - 1, b, dtype=U)))) for b in (BASE, inverse))


class Rolling:
    """Hash of any stretch of some bytes in constant time."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data)).bit_length())
        up, self.down = powers(size)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(letters()[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])
