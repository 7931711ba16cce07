"""Prefix polynomial hashes of byte strings, vectorised over numpy arrays.

Hashes are taken modulo 2**64 with odd bases, over random values for the bytes. Strings that are compared
here are under 200 bytes long, far below the 2,048 at which such hashes collide by construction.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all their bits are as good as random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def byte_values(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 1_000_003))


@functools.cache
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        step = np.full(n, b, dtype=U)
        step[0] = 1
        out.append(np.cumprod(step, dtype=U))
    return out[0], out[1]


class Prefixes:
    """Hashes of any substring of `raw`, a uint8 array of less than `room` bytes."""

    def __init__(self, raw: np.ndarray, base: int, seed: int, room: int) -> None:
        up, self.down = powers(base, room)
        self.sums = np.zeros(len(raw) + 1, dtype=U)
        np.cumsum(byte_values(seed)[raw] * up[: len(raw)], dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, by start."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]
