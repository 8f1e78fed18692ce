"""Hashes of all windows of a sequence at once, as numpy arrays of 64-bit numbers."""

import numpy as np

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the next call."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = _BASES[which]
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U))
        have = (made[0], made[1])
        if size <= 1 << 23:
            _powers[which] = have
    return have


class Windows:
    """Hashes of runs of consecutive elements; equal runs have equal hashes wherever they start."""

    def __init__(self, elements: np.ndarray, which: int = 0):
        n = len(elements)
        up, self.down = powers(which, n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(elements * up[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=U)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))


def byte_numbers(seed: int) -> np.ndarray:
    """A fixed 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BYTES = byte_numbers(7)
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a byte array."""
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = _IS_BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return Windows(_BYTES[data]).spans(starts, ends)
