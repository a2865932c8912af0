"""Deterministic generators for fixtures."""

from __future__ import annotations

#: The published constants of both generators.
MODULUS, MULTIPLIER = 2**31 - 1, 16_807
SHIFTS, STAR, START = (12, 25, 27), 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15


class MinimalStandard:
    """The Park-Miller generator: x becomes 16807 x modulo 2**31 - 1."""

    def __init__(self, seed: int):
        self.state = (seed & MODULUS) % MODULUS or 1

    def next(self) -> int:
        self.state = self.state * MULTIPLIER % MODULUS
        return self.state

    def uniform(self, n: int) -> int:
        if n <= 0:
            raise ValueError("n must be positive")
        return self.next() % n

    def one_in(self, n: int) -> bool:
        return self.uniform(n) == 0

    def skewed(self, max_log: int) -> int:
        """Below 2**k for a k drawn from 0 to `max_log`: small numbers are frequent."""
        return self.uniform(1 << self.uniform(max_log + 1))


class XorShiftStar:
    """64 bits by three shifts (12, 25, 27) and a multiplication."""

    def __init__(self, seed: int):
        self.state = seed or START

    def next(self) -> int:
        right, left, again = SHIFTS
        x = self.state
        x ^= x >> right
        x ^= x << left & 0xFFFFFFFFFFFFFFFF
        x ^= x >> again
        self.state = x
        return x * STAR & 0xFFFFFFFFFFFFFFFF

    def uniform(self, n: int) -> int:
        if n <= 0:
            raise ValueError("n must be positive")
        return self.next() % n
