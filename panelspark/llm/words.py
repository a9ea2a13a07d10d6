"""Hashing of words and their character n-grams with NumPy, many at a time."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x100000001B3


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * MIX
        x = (x ^ (x >> np.uint64(29))) * MIX
        return x ^ (x >> np.uint64(32))


def joined(words: list[bytes], before: bytes, after: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All words in one array, each between the two marks, and where each begins (one more entry: the end)."""
    data = np.frombuffer(b"".join(before + w + after for w in words), np.uint8)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + len(before) + len(after) for w in words], out=starts[1:])
    return data, starts


def gram_buckets(data: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each order n, the bucket of the n bytes from each position on (the last n - 1 positions wrap to shorter ones)."""
    out = []
    padded = np.concatenate([data, np.zeros(max(orders), np.uint8)]).astype(np.uint64)
    code = np.zeros(len(data), np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        for n in orders:
            for k in range(done, n):
                code = code * np.uint64(257) + padded[k : k + len(data)] + np.uint64(1)
            done = n
            out.append((mixed(code + np.uint64(n) * MIX) >> np.uint64(64 - bits)).astype(np.int64))
    return out


class Lookup:
    """Where distinct unsigned 64-bit keys stand in their array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        place = self._home(keys)
        while len(todo):
            free = self.table[place] < 0
            self.table[place[free]] = todo[free]  # of several, one stays
            left = self.table[place] != todo
            todo, place = todo[left], (place[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(keys) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key; -1 where it isn't among the keys."""
        place = self._home(wanted)
        out = self.table[place].astype(np.int64)
        if not len(self.keys):
            return out
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        place = place[todo]
        while len(todo):
            place = (place + 1) & self.mask
            found = self.table[place].astype(np.int64)
            out[todo] = found
            left = (found >= 0) & (self.keys[found] != wanted[todo])
            todo, place = todo[left], place[left]
        return out
