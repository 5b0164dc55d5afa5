"""Polynomial hashes modulo the prime 2**61 - 1 over byte texts laid end to end, in numpy.

The hash of bytes a..b is the sum of R[byte] * P**(i - a) over its places; prefix sums give it for any range in
constant time. Byte values go through a table of pseudo-random numbers R, results through a mixer. For two texts of n
bytes that differ, at most n of the 2**61 multipliers P give equal hashes (modulo a power of two, some pairs of texts
collide for every multiplier). Another ``seed`` is another multiplier and table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
PRIME = (1 << 61) - 1
_M, _LOW, _LOW29 = U(PRIME), U((1 << 32) - 1), U((1 << 29) - 1)
_AT_ONCE = 1 << 13  # numbers multiplied at once: what is in between stays in the cache


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _M) + (x >> U(61))
    x -= _M * (x >= _M)
    return x


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> U(32), a & _LOW, b >> U(32), b & _LOW
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    a1 *= b1
    a1 <<= U(3)  # 2**64 is 8, 2**61 is 1
    a1 += middle >> U(29)
    a1 += (middle & _LOW29) << U(32)
    a1 += low & _M
    a1 += low >> U(61)
    return _reduced(a1)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    if len(a) <= _AT_ONCE:
        return _product(a, b)
    return np.concatenate([_product(a[i : i + _AT_ONCE], b[i : i + _AT_ONCE]) for i in range(0, len(a), _AT_ONCE)])


class _Base:
    """Table of byte values and powers of the multiplier, up and down, for a seed."""

    def __init__(self, seed: int):
        draw = mix(np.arange(1, 260, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed) * U(0xA24BAED4963EE407))
        self.table = _reduced(draw[:256])
        self.multiplier = int(_reduced(draw[256:257])[0]) | 1 << 32
        self.powers = [np.ones(1, U), np.ones(1, U)]

    def grown(self, n: int) -> list[np.ndarray]:
        if len(self.powers[0]) < n:
            for i, base in enumerate((self.multiplier, pow(self.multiplier, -1, PRIME))):
                out = self.powers[i]
                while len(out) < max(n, 1 << 16):
                    out = np.concatenate([out, multiply(out, np.full(len(out), pow(base, len(out), PRIME), U))])
                self.powers[i] = out
        return [p[:n] for p in self.powers]


_base = lru_cache(maxsize=4)(_Base)


class Prefix:
    """Prefix hashes of a byte array: ``hash(a, b)`` for arrays of range ends."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        base = _base(seed)
        up, self._down = base.grown(len(data) + 1)
        values = multiply(base.table[data], up[:-1])
        high = np.cumsum(values >> U(32))
        self.sums = np.zeros(len(data) + 1, U)
        self.sums[1:] = _reduced((high >> U(29)) + ((high & _LOW29) << U(32)) + np.cumsum(values & _LOW))

    def _between(self, from_: np.ndarray, to: np.ndarray, down: np.ndarray) -> np.ndarray:
        return multiply(_reduced(to + (_M - from_)), down)

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._between(self.sums[a], self.sums[b], self._down[a])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b))


_wrapping = [np.ones(1, U), np.ones(1, U)]


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k bytes, by their start. Modulo 2**64, so cheap: it chooses substrings and places, and says nothing of equality."""
    if len(_wrapping[0]) < len(data):
        for i, base in enumerate((6364136223846793005, pow(6364136223846793005, -1, 1 << 64))):
            out = np.full(max(len(data), 1 << 16), base, U)
            out[0] = 1
            _wrapping[i] = np.multiply.accumulate(out)
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_base(0).table[data] * _wrapping[0][: len(data)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _wrapping[1][:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by their start."""
    span = 1
    while span < w and len(x):
        step = min(span, w - span)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        span += step
    return x
