"""Words of many texts at once, as hashes, in NumPy over the UTF-8 bytes of an Arrow batch.

Both kinds of word are runs of bytes of a class, after A-Z became a-z: every byte from 0x80 on belongs to
a word, so the classes can be tested on bytes without decoding.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: `[^\x20\x09-\x0D]`: all but white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[32, *range(9, 14)]] = False

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        size = max(n, 2 * len(_power), 64)
        _power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _power


class Words:
    """Words of texts that lie one after the other in `data`; text i is data[offsets[i]:offsets[i + 1]].

    starts, ends: byte positions of each word. first: n + 1 offsets of the texts' words. hashes: 64 bits of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        low = LOWER[data]
        inside = kind[low]
        lengths = np.diff(offsets)
        full = np.flatnonzero(lengths)
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[offsets[full]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = before  # reused
        after[:-1] = inside[1:]
        after[offsets[full + 1] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.low, self.inside = low, inside

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # a block at a time, to stay in the cache
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 18))))
            lo, hi = starts[at], ends[to - 1]
            s = starts[at:to] - lo
            width = np.diff(np.append(s, hi - lo))
            place = np.arange(hi - lo, dtype=np.int32) - np.repeat(s.astype(np.int32), width)
            value = powers(int(width.max()))[place]
            value *= BYTE[self.low[lo:hi]]
            value *= self.inside[lo:hi]
            out[at:to] = np.add.reduceat(value, s)
            at = to
        return mix(out)


#: Of the polynomials that shingles are.
BASE = 0x2545F4914F6CDD1D


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes; a shorter sequence is one shingle, an empty one none."""
    n = len(h)
    if n == 0:
        return h
    size = min(n, k)
    out, width = h, 1  # the polynomial of `width` words, doubled or made one word longer
    for bit in bin(size)[3:]:
        out = out[: len(out) - width] * np.uint64(pow(BASE, width, 1 << 64)) + out[width:]
        width *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(BASE) + h[width:]
            width += 1
    return mix(out + np.uint64(size))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted and without repeats."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h
