"""Line dedup: lines that many documents share stay in one document only.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z in lower case. Three passes over the texts, none of which moves a text:

1. Each task sends the distinct hashes of its lines' keys to shards by hash, those met in one document apart from those met in several. A shard keeps two
   Bloom filters: a hash that comes for the first time enters the once-seen filter, one that the once-seen filter knows (or that several documents of a
   task hold) enters the twice-seen filter. Hashes that the twice-seen filter knows are suspects: every repeated key, and a few that only look so.
2. Only suspected lines are shuffled, as 128-bit digests with their document's id; counting distinct ids confirms or clears them, and the greatest id keeps the line.
3. Each document drops its lines with a confirmed key, unless it is the keeper.

A hot line costs one hash a task in the first step and is counted in parts in the second. Up to `broadcast_keys` suspects and confirmed keys are broadcast, after they were counted;
beyond that, digests are joined by hash and the keys to be dropped are joined with the documents by id.

Edge cases: null or empty texts are one empty line, too short to be dropped; rows that repeat an id are one document (its lines are counted once, the keeper's lines stay in all its
rows); a null id is a document like any other, the least of all; a document that loses all its lines keeps an empty text; carriage returns belong to the line and are stripped
for the key only; texts of any length are read whole, one text at a time; an empty table gives an empty result; other columns are ignored unless named in `keep`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

LEAST, DOCS = 40, 5
#: What is stripped, and the bytes that continue a character.
SPACE = b" \t\n\x0b\x0c\r"
INNER = bytes(range(0x80, 0xC0))
#: Digests of 16 bytes: as many take 32 MB.
BROADCAST_KEYS = 2_000_000
#: Bytes of text for each shard of hashes: a shard holds 1.6 million hashes at most if lines have 40 bytes.
SHARD_BYTES = 64 << 20
#: A task sends its hashes when it holds so many.
HELD = 1 << 20
PROBES, BITS = 3, 8


def key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None if it has fewer than `least` code points."""
    own = line.strip(SPACE)
    if len(own) < least or (not own.isascii() and len(own.translate(None, INNER)) < least):
        return None
    return own.lower()


def digest(own: bytes) -> int:
    return xxhash.xxh3_128_intdigest(own)


def halves(digests: list[int]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(d.to_bytes(16, "little") for d in digests), np.uint64).reshape(-1, 2)
    return both[:, 1], both[:, 0]


def line_digests(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low halves of the digests of all lines that are long enough, and the rows that they are in."""
    data, offsets = common.utf8(batch.column("text"))
    found: list[int] = []
    sizes = np.zeros(batch.num_rows, np.int64)
    for row in range(batch.num_rows):
        before = len(found)
        for line in data[offsets[row] : offsets[row + 1]].split(b"\n"):
            if len(line) >= least and (own := key(line, least)) is not None:
                found.append(digest(own))
        sizes[row] = len(found) - before
    high, low = halves(found)
    return high, low, np.repeat(np.arange(batch.num_rows), sizes)


class Filter:
    """A Bloom filter of 64-bit hashes."""

    def __init__(self, expected: int):
        self.size = np.uint64((1 << max(10, (BITS * max(expected, 1) - 1).bit_length())) - 1)
        self.held = np.zeros(int(self.size) + 1, bool)

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(29)) | np.uint64(1)
        for i in range(PROBES):
            yield ((hashes + np.uint64(i) * step) & self.size).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            self.held[at] = True

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= self.held[at]
        return out


def suspected(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The hashes that the twice-seen filter knows. parts: distinct hashes that one document of a part holds, and those that several hold."""
    n = sum(len(one) + len(more) for one, more in parts)
    once, twice = Filter(n), Filter(n)
    for one, more in parts:
        twice.add(more)
        for hashes in (one, more):
            twice.add(hashes[once.knows(hashes)])
        once.add(one)
        once.add(more)
    return np.unique(np.concatenate([x[twice.knows(x)] for part in parts for x in part] or [np.zeros(0, np.uint64)]))


def suspects(docs: DataFrame, least: int, shard_bytes: int = SHARD_BYTES, held: int = HELD) -> DataFrame:
    """h long: hashes of keys that may be in several documents, a written table. docs: doc_id, text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (total // shard_bytes).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, n = [], [], 0

        def flush() -> pa.RecordBatch:
            own, place = np.unique(np.concatenate(hashes), return_inverse=True)
            times = np.bincount(place, np.concatenate(counts), len(own))
            hashes.clear()
            counts.clear()
            shard = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            rows = [(int(shard[a]), own[a:b][times[a:b] < 2].tobytes(), own[a:b][times[a:b] >= 2].tobytes()) for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "one", "more"])

        for batch in common.pieces(batches):
            high, _, rows = line_digests(batch, least)
            if not len(high):
                continue
            ids = np.unique(np.asarray(batch.column("doc_id").dictionary_encode().indices.fill_null(-1)), return_inverse=True)[1][rows]
            each = np.unique(np.stack([high, ids.astype(np.uint64)], 1), axis=0)[:, 0]  # a document's own repeats count once
            own, times = np.unique(each, return_counts=True)
            hashes.append(own)
            counts.append(times)
            n += len(own)
            if n >= held:
                yield flush()
                n = 0
        if n:
            yield flush()

    def sift(parts: pa.Table) -> pa.Table:
        arrays = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(parts.column("one").to_pylist(), parts.column("more").to_pylist(), strict=True)]
        found = suspected(arrays)
        common.released()
        return pa.table({"h": found.view(np.int64)})

    return common.written(docs.mapInArrow(send, "shard long, one binary, more binary").groupBy("shard").applyInArrow(sift, "h long"), "line-suspects")


def bounded(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def confirmed(docs: DataFrame, least: int, enough: int, broadcast_keys: int, **options) -> tuple[DataFrame, DataFrame]:
    """Suspected lines (h, g: the halves of the digest; doc_id), and the repeated keys with the id that keeps them (h, g, keeper), a written table."""
    found = suspects(docs, least, **options)
    small = bounded(found, broadcast_keys)
    known = docs.sparkSession.sparkContext.broadcast(np.sort(found.toArrow().column("h").to_numpy())) if small else None

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            high, low, rows = line_digests(batch, least)
            if small and len(high):
                own = known.value
                at = np.searchsorted(own, high.view(np.int64))
                hit = np.append(own, 0)[at] == high.view(np.int64)
                hit &= at < len(own)
                high, low, rows = high[hit], low[hit], rows[hit]
            if len(high):
                yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), batch.column("doc_id").take(pa.array(rows))], ["h", "g", "doc_id"])

    lines = docs.mapInArrow(pick, "h long, g long, doc_id long")
    lines = lines.distinct() if small else common.written(lines.join(found.hint("merge"), "h", "left_semi").distinct(), "line-digests")
    counted = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= enough)
    keys = common.written(counted.select("h", "g", "keeper"), "line-keys")
    common.drop_written(found)
    return lines, keys


def dedup(documents: DataFrame, least: int = LEAST, docs: int = DOCS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), broadcast_keys: int = BROADCAST_KEYS, **options) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept (the text without its dropped lines), and the columns of `keep`."""
    base = common.documents(documents, id_col, text_col)
    lines, keys = confirmed(base, least, docs, broadcast_keys, **options)
    kinds = [(c, documents.schema[c].dataType.simpleString()) for c in keep]
    wide = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    small, shared = bounded(keys, broadcast_keys // 8), None  # a dictionary's entry takes some 200 bytes
    if small:
        shared = documents.sparkSession.sparkContext.broadcast({struct.pack("<qq", g, h): keeper for h, g, keeper in zip(*(c.to_pylist() for c in keys.toArrow().columns), strict=True)})
        common.drop_written(keys)
    else:
        gone = lines.join(keys.hint("merge"), ["h", "g"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        gone = gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("g", "h")).alias("gone"))
        wide = wide.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")

    def cut(text: bytes, dropped) -> tuple[int, int, bytes]:
        split = text.split(b"\n")
        stay = [line for line in split if len(line) < least or (own := key(line, least)) is None or not dropped(xxhash.xxh3_128_digest(own)[::-1])]
        return len(split), len(split) - len(stay), b"\n".join(stay)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            data, offsets = common.utf8(batch.column("text"))
            ids, out = batch.column("doc_id").to_pylist(), []
            lists = None if small else batch.column("gone").to_pylist()
            for row, own_id in enumerate(ids):
                if small:
                    of = shared.value
                    test = lambda d, of=of, own_id=own_id: d in of and of[d] != own_id
                else:
                    own = {struct.pack("<qq", x["g"], x["h"]) for x in lists[row] or ()}
                    test = own.__contains__
                out.append(cut(data[offsets[row] : offsets[row + 1]], test))
            n, dropped, kept = zip(*out, strict=True)
            rest = [batch.column(f"keep_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string(), safe=False), *rest], ["doc_id", "n_lines", "n_dropped", "kept", *(f"keep_{i}" for i in range(len(keep)))])

    schema = "doc_id long, n_lines long, n_dropped long, kept string" + "".join(f", keep_{i} {kind}" for i, (_, kind) in enumerate(kinds))
    return wide.mapInArrow(drop, schema).withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT r, doc_id, p, w[p] AS line, translate(trim(w[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, range(1, len(w) + 1) t(p)),
many AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, many.k IS NOT NULL AND l.doc_id <> keeper AS gone FROM l LEFT JOIN many ON l.k = many.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
