"""Distinct word shingles of texts, a batch of texts at a time: as 128-bit hashes, and as they are."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash

from tallyspark.llm.sieve import mixed

WORDS = 5
#: A text is split into words so many bytes at a time, as the words of a piece are objects of their own.
SEGMENT = 1 << 20
KNOWN = 200_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Words(dict):
    """Numbers of words, and the 128-bit hash of each."""

    def __init__(self, seed: int):
        self.seed, self.digests = seed, bytearray()

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        self.digests += xxhash.xxh3_128_digest(word, self.seed)
        self[word] = number
        return number

    def hashes(self) -> np.ndarray:
        return np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)


@lru_cache(1)
def _words(seed: int) -> Words:
    return Words(seed)


def forget() -> None:
    """Drop the words known: a worker lives on after its task."""
    _words.cache_clear()


def _segments(low: bytes, a: int, b: int) -> list[bytes]:
    """low[a:b] cut at white space."""
    out = []
    while b - a > SEGMENT:
        found = _SPACE.search(low, a + SEGMENT, b)
        stop = found.start() if found else b
        out.append(low[a:stop])
        a = stop
    return [*out, low[a:b]]


def numbered(data: bytes, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers, text after text, and how many words each text has. bytes.split() cuts at exactly 09-0D and 20."""
    low, cuts = data.translate(LOWER), offsets.tolist()
    counts, out, held, size = np.zeros(len(cuts) - 1, np.int64), [], [], 0

    def flush() -> None:
        total = sum(map(len, held))
        out.append(np.fromiter(map(words.__getitem__, chain.from_iterable(held)), np.int32, total))
        held.clear()

    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for part in [low[a:b]] if b - a <= SEGMENT else _segments(low, a, b):
            held.append(part.split())
            counts[i] += len(held[-1])
            size += len(part)
            if size >= SEGMENT:
                flush()
                size = 0
    flush()
    return np.concatenate(out), counts


def _joint(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int, lane: int) -> np.ndarray:
    """A hash of the `sizes` words at each start: words' hashes times odd numbers of the places, added up and mixed."""
    odd = mixed(np.arange(1, words + 2, dtype=np.uint64) + np.uint64(lane << 32)) | np.uint64(1)
    total = sizes.astype(np.uint64) * odd[words]
    short = sizes.min() < words
    for k in range(words):
        if short:
            there = np.flatnonzero(sizes > k)
            total[there] += hashes[starts[there] + k] * odd[k]
        else:
            total += hashes[starts + k] * odd[k]
    return mixed(total)


def shingles(data: bytes, offsets: np.ndarray, words: int = WORDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first 64 bits of all distinct shingles, text after text and sorted within each; how many each text has; and two 64-bit signatures of each text's set.

    Words are runs of bytes other than space and 09-0D, with A-Z in lower case. A text of fewer words than a shingle has one: all of them; one without words has none.
    Shingles are told apart, and sets signed, by 128 bits.
    """
    n_texts, known = len(offsets) - 1, _words(seed)
    if len(known) > KNOWN:
        known.clear()
        known.digests.clear()
    ids, counts = numbered(data, offsets, known)
    none = np.zeros(n_texts, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64), none, none.copy()
    own = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(n_texts), own)
    begins = np.cumsum(counts) - counts
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own) + begins[owner]
    sizes = np.minimum(counts, words)[owner]
    table = known.hashes()
    first, second = (_joint(np.ascontiguousarray(table[:, lane])[ids], starts, sizes, words, lane) for lane in (0, 1))
    bits = max(n_texts - 1, 0).bit_length()
    key = first if not bits else (owner.astype(np.uint64) << np.uint64(64 - bits)) | (first >> np.uint64(bits))
    order = np.argsort(key)
    key, first, second, owner = key[order], first[order], second[order], owner[order]
    same, equal = key[1:] == key[:-1], (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    if (same & ~equal).any():  # two shingles of a text have one key: order by all bits
        order = np.lexsort((second, first, owner))
        first, second, owner = first[order], second[order], owner[order]
        same, equal = owner[1:] == owner[:-1], (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    new = np.append(True, ~(same & equal))
    first, second, owner = first[new], second[new], owner[new]
    totals = np.bincount(owner, minlength=n_texts)
    full = np.flatnonzero(totals)
    at = (np.cumsum(totals) - totals)[full]
    signed = []
    for lane in (first, second):
        sums = none.copy()
        sums[full] = np.add.reduceat(mixed(lane ^ np.uint64(0xD6E8FEB86659FD93)), at)
        signed.append(sums)
    return first, totals, signed[0], signed[1]


def exact(text: str | None, words: int = WORDS) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    own = (text or "").encode().translate(LOWER).split()
    return set(zip(*(own[k:] for k in range(words)))) if len(own) >= words else {tuple(own)} if own else set()
