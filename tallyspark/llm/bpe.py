"""Byte-level BPE: encoding and decoding of whole texts with a published vocabulary.

Pre-tokens are found without regular expressions. Every code point gets a class; classes that need to look ahead (a space before a
word, the last of several spaces, an apostrophe that opens a contraction) are told apart with array comparisons. Each class is a transition
function of a small automaton, and the composition of such functions is associative: the functions of a block are composed for all blocks
at once, a scan over the blocks' compositions gives the state at each block's start, and a second sweep marks where pre-tokens begin. The
byte slices between the marks are merged pair by pair, lowest rank first, and kept in a cache.

Decoding gathers the bytes of all ids from one buffer by their offsets.

Edge cases: null texts count as empty; an empty text has no ids and decodes to nothing; every input row gives one output row, repeated rows too;
texts of any length are encoded whole (pieces of unusual length are merged with a heap); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

VOCABULARY = "byte_bpe_50k.tiktoken"

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the pattern splits off, by the letters after the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, SPACES, SPACE_BEFORE, SPACE_LAST, SHORT, LONG = range(8)
CLASSES, FIRST = 8, 8  # FIRST is added to the class of a text's first code point
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, AFTER_SPACE, TAKE_ONE, TAKE_TWO = range(8)
STATES = 8
BLOCK = 64
CACHED, CACHED_BYTES = 250_000, 48
PIECE = 1 << 20  # bytes of text or ids at a time: a piece makes about as many small objects as it has words


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins at this code point."""
    if state == TAKE_TWO:
        return TAKE_ONE, False
    if state == TAKE_ONE:
        return START, False
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: IN_OTHER, LONG: IN_OTHER}.get(kind)
    if run is not None and state in (run, AFTER_SPACE):
        return run, False
    if kind in (SHORT, LONG):
        return (TAKE_ONE if kind == SHORT else TAKE_TWO), True
    if run is not None:
        return run, True
    if kind == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (AFTER_SPACE if kind == SPACE_BEFORE else START), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """steps[state, class]: next state, + 128 where a pre-token begins; of[class]: its function's number; joined[f, g]: the number of f then g; ends[f, state]."""
    steps = np.zeros((STATES, 2 * CLASSES), np.uint8)
    for kind in range(CLASSES):
        for state in range(STATES):
            for first in (0, FIRST):
                to, begins = _step(START if first else state, kind)
                steps[state, kind + first] = to + 128 * begins
    functions = [tuple(steps[:, k] & 127) for k in range(2 * CLASSES)]
    known: dict[tuple, int] = {tuple(range(STATES)): 0}
    for f in functions:
        known.setdefault(f, len(known))
    grown = True
    while grown:
        before = list(known)
        for f in before:
            for g in before:
                known.setdefault(tuple(g[s] for s in f), len(known))
        grown = len(known) > len(before)
    joined = np.zeros((len(known), len(known)), np.uint16)
    for f, i in known.items():
        for g, j in known.items():
            joined[i, j] = known[tuple(g[s] for s in f)]
    return steps, np.array([known[f] for f in functions], np.uint16), joined, np.array(list(known), np.uint8)


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = SPACES
    return kinds


def _scan(totals: np.ndarray, joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The state before each function of a row of functions that begins in START."""
    n, size = len(totals), len(joined)
    if n <= BLOCK:
        out, state = np.zeros(n, np.uint8), START
        for i, f in enumerate(totals.tolist()):
            out[i], state = state, int(ends[f, state])
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint16)
    grid[:n] = totals
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat, flat_ends, composed = joined.ravel(), ends.ravel(), grid[0]
    for j in range(1, BLOCK):
        composed = flat[composed.astype(np.intp) * size + grid[j]]
    state, out = _scan(composed, joined, ends), np.zeros((BLOCK, rows), np.uint8)
    for j in range(BLOCK):
        out[j] = state
        state = flat_ends[grid[j].astype(np.intp) * STATES + state]
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Indices of the code points at which a pre-token begins. firsts: where each non-empty text begins in points, in order."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kinds = code_point_classes()[points]
    last = np.zeros(n + 1, bool)
    last[np.append(firsts[1:], n) - 1] = True
    spaces = np.flatnonzero(kinds == SPACES)
    before = ~last[spaces] & (kinds[np.minimum(spaces + 1, n - 1)] != SPACES)
    marks = np.flatnonzero(points == ord("'"))
    after = np.zeros((3, len(marks)), np.uint32)
    for k in (1, 2):
        inside = ~last[marks] if k == 1 else inside & ~last[np.minimum(marks + 1, n)]
        after[k][inside] = points[marks[inside] + k]
    for letters in CONTRACTIONS:
        fits = (after[1] == ord(letters[0])) & ((after[2] == ord(letters[-1])) if len(letters) == 2 else True)
        kinds[marks[fits]] = SHORT if len(letters) == 1 else LONG
    kinds[spaces[before]] = np.where(points[spaces[before]] == 0x20, SPACE_BEFORE, SPACE_LAST)
    kinds[firsts] += FIRST
    steps, of, joined, ends = automaton()
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, SPACES, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat, size, by_class = joined.ravel(), len(joined), of
    composed = by_class[grid[0]]
    for j in range(1, BLOCK):
        composed = flat[composed.astype(np.intp) * size + by_class[grid[j]]]
    state, begins, flat_steps = _scan(composed, joined, ends), np.zeros((BLOCK, rows), bool), steps.ravel()
    for j in range(BLOCK):
        to = flat_steps[state.astype(np.intp) * (2 * CLASSES) + grid[j]]
        begins[j], state = to >= 128, to & 127
    return np.flatnonzero(begins.T.ravel()[:n])


class Coder:
    """A vocabulary of byte strings by rank; ids of pre-tokens are cached, up to CACHED of them."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache = _Cache(self)

    def merged(self, piece: bytes) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        parts = self._short(piece) if len(piece) <= 100 else self._long(piece)
        return b"".join([self.ranks[p].to_bytes(4, "little") for p in parts])

    def _short(self, piece: bytes) -> list[bytes]:
        get, none = self.ranks.get, len(self.offsets)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _long(self, piece: bytes) -> list[bytes]:
        """The same merges by a heap over linked parts: n log n for long runs."""
        n, get = len(piece), self.ranks.get
        stop, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not alive[a] or stop[a] != b or b >= n or not alive[b] or stop[b] != c:
                continue
            alive[b], stop[a] = False, c
            if c < n:
                prev[c] = a
                if (r := get(piece[a : stop[c]])) is not None:
                    heapq.heappush(heap, (r, a, c, stop[c]))
            if (p := prev[a]) >= 0 and (r := get(piece[p:c])) is not None:
                heapq.heappush(heap, (r, p, a, c))
        return [piece[i : stop[i]] for i in range(n) if alive[i]]

    def encode(self, data: bytes, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text; data: the texts' joined UTF-8 bytes."""
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        firsts = np.searchsorted(at, np.unique(offsets[:-1][np.diff(offsets) > 0]))
        starts = at[boundaries(points, firsts)] if len(points) else at
        edges = np.append(starts, len(data)).tolist()
        found = list(map(self.cache.__getitem__, [data[a:b] for a, b in zip(edges, edges[1:])]))
        cuts = np.searchsorted(starts, offsets).tolist()
        return [b"".join(found[a:b]) for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, and each id's offset in them."""
        ids = ids.astype(np.int64)
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.bytes[at].tobytes(), np.append(ends - sizes, total)


class _Cache(dict):
    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.coder.merged(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def coder(file: bytes) -> Coder:
    return Coder(file)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit); with decoded=True also decoded (binary), the bytes that the ids stand for.

    vocabulary: a file of base64 tokens and ranks, read by the driver and sent to the executors (its size is fixed).
    """
    with open(vocabulary, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file.value)
        for batch in common.pieces(batches, most=PIECE):
            data, offsets = common.utf8(batch.column("text"))
            ids = own.encode(data, offsets)
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            columns = [batch.column("doc_id"), pa.array(counts), pa.array(ids, pa.binary())]
            if decoded:
                back, at = own.decode(np.frombuffer(b"".join(ids), "<u4"))
                cuts = at[np.append(0, np.cumsum(counts))].tolist()
                columns.append(pa.array([back[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])
        if len(own.cache) > CACHED // 4:  # a worker lives on after its task
            own.cache.clear()
        common.released()

    return common.documents(df, id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (binary), ends (array<int>: where each id's bytes end) from ids as encode() returns them; null ids decode to nothing."""
    with open(vocabulary, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file.value)
        for batch in common.pieces(batches, "ids", PIECE):
            found = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.binary()), pa.array([at[1:].astype(np.int32) for _, at in found], pa.list_(pa.int32()))], ["doc_id", "decoded", "ends"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary, ends array<int>")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(common.table(spark, sf_dir, "documents"), default_vocabulary(), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
