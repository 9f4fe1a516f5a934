"""Texts as sequences of pieces, each worked on once while a worker remembers it.

Pieces are looked up by a 64-bit hash in an open-addressing table, all pieces of a block at once; what is found is compared with the
remembered bytes, and a text in which they differ is worked on as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .words import BYTE, mix, powers

#: Pieces that a worker remembers, their bytes, and slots of the table (a power of two); only speed depends on them.
REMEMBERED, REMEMBERED_BYTES, SLOTS = 2_000_000, 32 << 20, 1 << 22

#: Signs that may close a word.
SIGNS = ".,;:!?"
#: Bytes of the letters A-Z and a-z; of SIGNS.
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
SIGN[list(SIGNS.encode())] = True


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space. Some rare visible characters count too: texts are cut at fewer places then."""
    out = (data <= 32) | (data == 127)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    for lead, size in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data == lead)
        b, c = padded[at + 1], padded[at + 2]
        if lead == 0xC2:  # U+0085, U+00A0
            found = (b == 0x85) | (b == 0xA0)
        elif lead == 0xE1:  # U+1680 and its neighbours
            found = b == 0x9A
        elif lead == 0xE2:  # U+2000 to U+200F, U+2028 to U+202F, U+2040 to U+207F
            found = (b == 0x80) & ((c < 0x90) | (c >= 0xA8) & (c < 0xB0)) | (b == 0x81)
        else:  # U+3000
            found = (b == 0x80) & (c == 0x80)
        for k in range(size):
            out[at[found] + k] = True
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to Latin letters up to U+017F."""
    out = LETTER[data]
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    at = at[at + 1 < len(data)]
    at = at[(data[at] != 0xC3) | (data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]  # the signs for times and division
    out[at] = out[at + 1] = True
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: at a text's start, before each single space between two visible characters, and between letters
    and the signs that close them. A pre-tokenizer has borders there, whatever stands further off."""
    blank = spaces(data)
    begins = data == 32
    begins[1:] &= ~blank[:-1]
    begins[:-1] &= ~blank[1:]
    full = np.flatnonzero(np.diff(offsets))
    begins[offsets[full + 1] - 1] = False
    begins[offsets[full]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    n_signs = np.append(0, np.cumsum(SIGN[data], dtype=np.int64))
    n_letters = np.append(0, np.cumsum(letters(data), dtype=np.int64))
    closing = n_signs[ends] - n_signs[starts]
    core = n_letters[ends] - n_letters[starts]
    at = ends - closing
    closed = (closing > 0) & (core > 0) & (core + closing + (data[starts] == 32) == ends - starts) & (n_signs[ends] - n_signs[at] == closing)
    begins[at[closed]] = True
    return np.flatnonzero(begins)


def piece_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits for each piece of a block that begins with the first start."""
    width = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), width)
    value = powers(int(width.max()))[place]
    value *= BYTE[data]
    return mix(np.add.reduceat(value, starts) + width.astype(np.uint64))


def runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    before = np.cumsum(count) - count
    return np.repeat(begin - before, count) + np.arange(int(count.sum()))


def grown(array: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The array with `more` from n on; with twice the room when it is full."""
    if n + len(more) > len(array):
        array = np.concatenate([array[:n], np.empty(max(len(array), 2 * len(more)), array.dtype)])
    array[n : n + len(more)] = more
    return array


class Table:
    """For each piece one or more stretches of values, a column each. A subclass says what they are.

    made(raw, at): for pieces raw[at[i]:at[i + 1]], per column all values and how many each piece has. whole(raw): per column the values
    of one text.
    """

    def __init__(self, kinds: list[np.dtype], block: int):
        self.kinds, self.size_of_block = kinds, block
        self.keys, self.places = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.forget()

    def made(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        raise NotImplementedError

    def whole(self, raw: bytes) -> list[np.ndarray]:
        raise NotImplementedError

    def forget(self) -> None:
        self.places.fill(-1)
        self.n = 0
        self.flat = [np.empty(1 << 20, kind) for kind in [np.dtype(np.uint8), *self.kinds]]  # the pieces themselves, then the columns
        self.at = [np.zeros(1 << 16, np.int64) for _ in self.flat]  # n + 1 offsets

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of remembered pieces, -1 for others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            at = slot[left]
            place = self.places[at]
            hit = (place >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = place[hit]
            left = left[(place >= 0) & ~hit]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return out

    def enter(self, keys: np.ndarray, places: np.ndarray) -> None:
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.places[slot[left]] < 0]
            self.places[slot[free]] = places[free]  # of several that want a slot the last one gets it
            got = free[self.places[slot[free]] == places[free]]
            self.keys[slot[got]] = keys[got]
            left = left[self.places[slot[left]] != places[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    def learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Remembers new distinct pieces, data[begin:begin + size] each."""
        raw = data[runs(begin, size)]
        columns = [(raw, size), *self.made(raw, np.append(0, np.cumsum(size)))]
        for k, (values, counts) in enumerate(columns):
            end = self.at[k][self.n]
            self.flat[k] = grown(self.flat[k], end, values)
            self.at[k] = grown(self.at[k], self.n + 1, end + np.cumsum(counts))
        self.enter(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def block(self, data: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Per column all values and how many each piece has; pieces that aren't what their hash stands for."""
        code, distinct = pd.factorize(piece_hashes(data, starts))
        size = np.diff(np.append(starts, len(data)))
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        place = self.find(distinct)
        new = np.flatnonzero(place < 0)
        if self.n + len(new) > REMEMBERED or self.at[0][self.n] + size[first[new]].sum() > REMEMBERED_BYTES:
            self.forget()
            new = np.arange(len(distinct))
        if len(new):
            self.learn(distinct[new], data, starts[first[new]], size[first[new]])
            place = self.find(distinct)
        place = place[code]
        begin = [at[place] for at in self.at]
        count = [at[place + 1] - b for at, b in zip(self.at, begin, strict=True)]
        if np.array_equal(count[0], size) and np.array_equal(self.flat[0][runs(begin[0], size)], data):
            wrong = np.empty(0, np.int64)
        else:
            wrong = np.array([k for k, (i, n, j, m) in enumerate(zip(starts, size, begin[0], count[0], strict=True)) if n != m or not np.array_equal(data[i : i + n], self.flat[0][j : j + m])], np.int64)
        return [(f[runs(b, n)], n) for f, b, n in zip(self.flat[1:], begin[1:], count[1:], strict=True)], wrong

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per column all values of texts, data[offsets[i]:offsets[i + 1]] each, and offsets of the texts' values."""
        if not len(data):
            return [(np.empty(0, kind), np.zeros(len(offsets), np.int64)) for kind in self.kinds]
        starts = cut(data, offsets)
        at, blocks, wrong = 0, [], []
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + self.size_of_block)))
            end = starts[to] if to < len(starts) else len(data)
            columns, w = self.block(data[starts[at] : end], starts[at:to] - starts[at])
            blocks.append(columns)
            wrong.append(w + at)
            at = to
        bad = np.unique(np.searchsorted(offsets, starts[np.concatenate(wrong)], "right") - 1).tolist()
        right = {i: self.whole(data[offsets[i] : offsets[i + 1]].tobytes()) for i in bad}
        first, out = np.searchsorted(starts, offsets), []
        for k, parts in enumerate(zip(*blocks, strict=True)):
            values, upto = np.concatenate([v for v, _ in parts]), np.append(0, np.cumsum(np.concatenate([n for _, n in parts])))[first]
            if bad:
                each = np.split(values, upto[1:-1])
                for i in bad:
                    each[i] = right[i][k]
                values, upto = np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))
            out.append((values, upto))
        return out
