"""Media columns: byte payloads stored as 8-bit grey PNG images in a binary column, read back with checksum tests, and hashed.

The writer lays a payload out 64 samples a row, picks one of the None, Sub and Up filters for each row by the least sum of absolute
differences, and compresses with zlib. The reader walks the chunks, tests every CRC-32, inflates, and undoes all five filters in numpy: rows of None, Sub
and Up by cumulative sums, runs with Average or Paeth rows along anti-diagonals. The feature is a perceptual hash: the image is averaged to
32 x 32, transformed by a cosine transform, and the 8 x 8 lowest frequencies are compared with their median (64 bits).

Edge cases: null texts count as empty; an empty payload is 64 zero bytes; every input row gives one output row, repeated rows too; payloads of any
length are stored whole; broken images raise MediaError; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
SIDE, LOW = 32, 8


class MediaError(ValueError):
    """The bytes are not a sound image of the kind that this module reads."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray, level: int = 4) -> bytes:
    """An 8-bit grey PNG of a two-dimensional uint8 array."""
    h, w = samples.shape
    up, sub = samples.copy(), samples.copy()
    up[1:] -= samples[:-1]
    sub[:, 1:] -= samples[:, :-1]
    forms = (samples, sub, up)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in forms])
    choice = cost.argmin(0)
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = choice
    rows[:, 1:] = samples
    for kind in (SUB, UP):
        own = choice == kind
        rows[own, 1:] = forms[kind][own]
    header = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _diagonals(rows: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undo any filters of consecutive rows: a sample needs only its left, upper and upper left neighbours, so an anti-diagonal goes at once."""
    h, w = rows.shape
    out = np.zeros((h + 1, w + 1), np.int32)
    out[0, 1:] = above
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - r
        left, up, corner, kind = out[r + 1, c], out[r, c + 1], out[r, c], kinds[r]
        guess = left + up - corner
        pa_, pb, pc = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))
        add = np.select([kind == SUB, kind == UP, kind == AVERAGE, kind == PAETH], [left, up, (left + up) >> 1, paeth], 0)
        out[r + 1, c + 1] = (rows[r, c] + add) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Samples of filtered rows. kinds: each row's filter."""
    if len(kinds) and kinds.max() > PAETH:
        raise MediaError("unknown filter")
    out = rows.copy()
    sub = kinds == SUB
    if sub.any():
        out[sub] = np.cumsum(rows[sub], 1, dtype=np.uint8)
    edges = np.flatnonzero(np.append(True, (kinds[1:] > SUB) != (kinds[:-1] > SUB))).tolist() + [len(kinds)]
    for a, b in zip(edges, edges[1:]):
        if kinds[a] <= SUB:
            continue
        above = out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if (kinds[a:b] == UP).all():
            out[a:b] = np.cumsum(rows[a:b], 0, dtype=np.uint8) + above
        else:
            out[a:b] = _diagonals(rows[a:b], kinds[a:b], above)
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, non-interlaced PNG. Every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise MediaError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise MediaError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a whole 8-bit grey image")
    w, h = header[:2]
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), h * (w + 1) + 1)  # no more than the header promises
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != h * (w + 1):
        raise MediaError("wrong number of samples")
    grid = np.frombuffer(raw, np.uint8).reshape(h, w + 1)
    return unfilter(grid[:, 1:], grid[:, 0])


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def _averaged(x: np.ndarray, side: int) -> np.ndarray:
    """Rows averaged into `side` bins; with fewer rows, each is repeated."""
    n = len(x)
    if n < side:
        return x[np.arange(side) * n // side]
    at = np.arange(side) * n // side
    return np.add.reduceat(x, at, axis=0) / np.diff(np.append(at, n))[:, None]


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits in 8 bytes: which of the 8 x 8 lowest frequencies lie above their median."""
    small = _averaged(_averaged(samples.astype(np.float64), SIDE).T, SIDE).T
    low = (_cosines() @ small @ _cosines().T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes()




def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding), media: the text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            data, offsets = common.utf8(batch.column("text"))
            cuts = offsets.tolist()
            media = []
            for a, b in zip(cuts, cuts[1:]):
                rows = max(1, -(-(b - a) // WIDTH))
                media.append(write_png(np.frombuffer(data[a:b].ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def unpacked(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the images of each have at most `most` samples by their headers, or are one."""
    for batch in common.pieces(batches, "media", 1 << 20):
        sizes = [int.from_bytes(x[16:20], "big") * int.from_bytes(x[20:24], "big") for x in batch.column("media").to_pylist()]
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def load(df: DataFrame) -> DataFrame:
    """Rows of store() with payload (the samples read back), crc (of the last 64, unsigned) and phash (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            images = [read_png(x) for x in batch.column("media").to_pylist()]
            payloads = [x.tobytes() for x in images]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), pa.array(payloads, pa.binary()), pa.array([zlib.crc32(x[-WIDTH:]) for x in payloads], pa.int64()), pa.array([cosine_hash(x) for x in images], pa.binary())],
                ["doc_id", "n_bytes", "media", "payload", "crc", "phash"],
            )

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, crc long, phash binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(store(common.table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.col("crc").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("phash")).alias("feature"), "phash",
    )
