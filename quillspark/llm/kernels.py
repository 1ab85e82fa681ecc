"""Vectorised text kernels: word bounds, polynomial hashes of ranges, super-k-mers.

A range hash is a polynomial modulo 2**64 over random 64-bit symbol values, passed through a
64-bit finaliser. Operators always compare two independent hashes, 128 bits together."""

from __future__ import annotations

import numpy as np

U = np.uint64
LOW32 = U(0xFFFFFFFF)
HIGH32 = U(0xFFFFFFFF00000000)

#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class RangeHash:
    """Hashes any range of a symbol sequence in constant time after one prefix pass."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 2**64 - 1, 256, np.uint64, endpoint=True)
        self.base = int(rng.integers(0, 2**62)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = -(-n // 65536) * 65536
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of 64-bit symbol values; feed to ``ranges``."""
        n = len(values)
        self._powers(n + 1)
        out = np.empty(n + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def bytes_prefix(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(self.table[data])

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """The hash of every range of ``size`` symbols."""
        n = max(0, len(prefix) - size)
        return mix((prefix[size : size + n] - prefix[:n]) * self.down[:n])


FIRST, SECOND, THIRD = RangeHash(101), RangeHash(202), RangeHash(303)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of texts laid end to end, and each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    firsts = offsets[:-1]
    firsts = firsts[firsts < len(data)]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[firsts[firsts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(hasher: RangeHash, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    return hasher.ranges(hasher.bytes_prefix(data), starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[: len(values) - (width - size)], values[width - size :])
    return values


def super_kmers(first: np.ndarray, second: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """Cut every window of ``window`` symbols into runs that share one minimiser occurrence.

    first, second: symbol values for two independent hashes; offsets: bounds of the texts.
    Returns arrays (text index, start in the text, number of windows, minimiser's hash, hash of the
    whole run). The minimiser of a window depends on the window alone, so equal windows always
    lie in runs with the same minimiser hash, at the same distance from the minimiser."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(first) < window:
        return none
    kmers = FIRST.windows(FIRST.prefix(first), k)
    # The upper half of the hash decides; ties go to the leftmost position, held in the lower half.
    packed = (kmers & HIGH32) | np.arange(len(kmers), dtype=np.uint64)
    least = sliding_min(packed, window - k + 1)
    valid = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(offsets)
    fits = sizes >= window
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, offsets[1:][fits] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return none
    place = (least[at] & LOW32).astype(np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    # Windows of one minimiser occurrence are adjacent and in one text, as no valid window crosses texts.
    np.not_equal(place[1:], place[:-1], out=new[1:])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(at)))
    start = at[heads]
    whole = SECOND.prefix(second)
    run = SECOND.ranges(whole, start, start + count + window - 1)
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start - offsets[text], count, kmers[place[heads]], run
