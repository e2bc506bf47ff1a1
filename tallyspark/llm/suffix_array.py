"""Suffix arrays of byte regions in numpy: Larsson-Sadakane refinement, Kasai common prefixes along many lanes at once."""

from __future__ import annotations

import numpy as np

LANE = 1024


class Regions:
    """Byte strings laid end to end, each with a sentinel of its own after it that sorts before all bytes."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.zeros(len(strings), np.int64)
        np.cumsum(self.sizes[:-1] + 1, out=self.starts[1:])
        self.n = int(self.sizes.sum()) + len(strings)
        self.data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.ends = np.repeat(self.starts + self.sizes, self.sizes + 1)  # where the sentinel after each position is

    def suffix_array(self) -> np.ndarray:
        n, ends, at = self.n, self.ends, np.arange(self.n)
        room = ends - at
        symbols = np.where(room > 0, self.data.astype(np.uint64) + np.uint64(1), np.uint64(0))
        key = np.zeros(n, np.uint64)
        for k in range(7):  # seven symbols of nine bits; nothing counts behind the sentinel
            part = np.zeros(n, np.uint64)
            part[: n - k] = symbols[k:]
            key = (key << np.uint64(9)) | np.where(room >= k, part, np.uint64(0))
        last = np.flatnonzero(room == 0)
        key[last] = np.arange(len(last), dtype=np.uint64)  # below any key that begins with a byte
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        new = np.append(True, key[order][1:] != key[order][:-1])
        first = np.flatnonzero(new)
        rank[order] = np.repeat(first, np.diff(np.append(first, n)))  # a group's number is its first place
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of more than one
        depth = 7
        while len(open_):
            members = order[open_]
            group = rank[members]
            second = rank[np.minimum(members + depth, ends[members])]
            by = np.argsort((group.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), kind="stable")
            members, group, second = members[by], group[by], second[by]
            order[open_] = members
            new = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
            first = np.flatnonzero(new)
            rank[members] = np.repeat(open_[first], np.diff(np.append(first, len(members))))
            open_ = open_[~(new & np.append(new[1:], True))]
            depth *= 2
        return order

    def common_prefixes(self, order: np.ndarray, most: int) -> np.ndarray:
        """For each place in order, the bytes that its suffix shares with the one before, counted up to `most`.

        Going through the text, a suffix shares at least one byte less than the suffix one position earlier; the text is cut into lanes that start
        from nothing, and all lanes take each step together.
        """
        n = self.n
        before = np.full(n, -1, np.int64)
        before[order[1:]] = order[:-1]
        words = np.zeros(n, np.uint64)
        padded = np.append(self.data, np.zeros(8, np.uint8)).astype(np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | padded[k : k + n]
        shared, lanes = np.zeros(n, np.int64), np.arange(0, n, LANE)
        h = np.zeros(len(lanes), np.int64)
        for step in range(LANE):
            at = lanes + step
            use = at < n
            if not use.all():
                lanes, at, h = lanes[use], at[use], h[use]
            h = np.maximum(h - 1, 0)
            other = before[at]
            room = np.where(other < 0, 0, np.minimum(self.ends[at] - at, self.ends[other] - other))
            h = np.minimum(h, room)
            busy = np.flatnonzero((h < np.minimum(room, most)))
            while len(busy):
                i, j = at[busy] + h[busy], other[busy] + h[busy]
                differs = words[i] ^ words[j]
                equal = np.full(len(busy), 8, np.int64)
                odd = differs != 0
                # the number of leading zero bytes: from the exponent of the value, rounded down
                top = np.frexp((differs[odd] >> np.uint64(11)).astype(np.float64))[1] + 11
                small = differs[odd] < np.uint64(1 << 11)
                top[small] = np.frexp(differs[odd][small].astype(np.float64))[1]
                equal[odd] = (64 - top) // 8
                h[busy] = np.minimum(h[busy] + equal, room[busy])
                busy = busy[~odd & (h[busy] < np.minimum(room[busy], most))]
            shared[at] = h
        return shared[order]

    def repeated(self, length: int) -> np.ndarray:
        """Whether the string of `length` bytes at each position also starts at another one."""
        out = np.zeros(self.n, bool)
        if self.n:
            order = self.suffix_array()
            same = self.common_prefixes(order, length) >= length
            out[order] = same | np.append(same[1:], False)
        return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals united where they overlap or touch, in order."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.append(True, starts[1:] > ends[:-1])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]
