"""Anchors of texts: positions that any two equal strings of a given length share.

Every string of `length` bytes holds length - gram + 1 grams; the one with the least hash (the leftmost of equals) is the string's anchor. Equal
strings have their anchors at the same place, so occurrences of a repeated string meet at equal anchors.
"""

from __future__ import annotations

import numpy as np

#: Long grams keep apart texts that share lines shorter than a string; short ones make fewer anchors.
GRAM = 240
ROOT = np.uint64(0x9E3779B97F4A7C15)
KEPT = (2 << 20) + 1
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of the hash's base and of its inverse, as many as were needed so far; those beyond KEPT aren't held on to."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) >= n:
            return cls.up[:n], cls.down[:n]
        up, down = (np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(n - 1, r, np.uint64))) for r in (ROOT, INVERSE))
        if n <= KEPT:
            cls.up, cls.down = up, down
        return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Polynomial hashes (mod 2**64, mixed) of any substrings of data."""

    def __init__(self, data: np.ndarray):
        up, self.down = Powers.of(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return mixed((self.prefix[size:] - self.prefix[:n]) * self.down[:n])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    before = np.minimum.accumulate(grid, 1).ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(hashes: Hashes, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors in the joined texts, their hashes, and the texts they belong to. offsets: where texts begin, and the end."""
    sizes = np.diff(offsets)
    total, w = int(offsets[-1]), length - gram + 1
    none = np.zeros(0, np.int64)
    if total < length or sizes.max(initial=0) < length:
        return none, none.astype(np.uint64), none
    grams = hashes.grams(gram)
    bits = np.uint64(int(total).bit_length())
    least = sliding_least((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), w)
    at = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    inside = np.ones(len(at), bool)  # strings within one text
    ends = offsets[1:]
    mark = np.zeros(total + 1, np.int32)
    np.add.at(mark, np.maximum(ends - length + 1, offsets[:-1]), 1)
    np.add.at(mark, ends, -1)
    inside = np.cumsum(mark)[: len(at)] == 0
    at = at[inside]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, grams[at], np.searchsorted(offsets, at, "right") - 1
