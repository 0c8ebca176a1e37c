"""Hashes of many spans at once: polynomial prefix sums over 64-bit integers, mixed at the end."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
_BYTE = np.array([(i + 1) * 0x9E3779B97F4A7C15 & MASK for i in range(256)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(_BYTE)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i below n, kept for the next call."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        m = max(1024, 1 << (n - 1).bit_length())
        got = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[base] = got
    return got


class Spans:
    """Hashes of spans of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray, base: int = 0xD1342543DE82EF95) -> None:
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_values(data: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte."""
    return _BYTE[data]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a line feed after each, and where each begins and the last ends."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in joined texts, and of each text the index of its first word (and the end)."""
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    return starts, ends, np.searchsorted(starts, bounds)
