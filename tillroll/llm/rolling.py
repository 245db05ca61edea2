"""Hashes of byte ranges from prefix sums, for whole arrays at once.

A range is hashed as a polynomial in an odd base over 64-bit words. Sums over prefixes give the hash of
any range by a subtraction and a multiplication with an inverse power, which exists as the base is odd.
"""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _chain(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base, and of its inverse, up to n."""
    known = _powers.get(base)
    if known is None or len(known[0]) <= n:
        size = 1 << max(16, n.bit_length())
        known = _chain(base, size), _chain(pow(base, -1, 1 << 64), size)
        if size <= 1 << 22:
            _powers[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    up, _ = powers(base, len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def ranges(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the bytes from begin to end."""
    _, down = powers(base, len(sums))
    return mix((sums[end] - sums[begin]) * down[begin])


def windows(sums: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of all ranges of `size` bytes, by where they begin."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(base, len(sums))
    return mix((sums[size:] - sums[:n]) * down[:n])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each `size` neighbours, by the first of them."""
    out, done = x, 1
    while 2 * done <= size:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = size - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
