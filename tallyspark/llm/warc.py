"""WARC archives (.warc.zst): a dictionary-compressed writer and a reader.

The writer gathers records up to `archive_bytes`, builds a Zstandard dictionary from an even choice of them, puts it in a leading skippable frame, and
compresses each record as a frame of its own, so that any record can be read with the dictionary alone. Archives are written to the
shared folder under names of their own; only the archives of tasks that succeeded are listed in the manifest, a written table, and
only those are read. Payloads of at least `revisit_bytes` that equal another record's become revisit records of the one with the largest id.

Edge cases: a null html is an empty payload; a null url is written as about:blank; a null id is written empty and reads back as null (and as a keeper comes
after any other id); rows that repeat both the keeper's id and its payload are responses again; every input row is one record; an empty
table gives no archive and an empty result; a payload of any length is one record, whole, and one longer than `archive_bytes` ends its archive;
control characters in urls are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

# Names and numbers of the WARC and Zstandard formats.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_FRAME = 0x184D2A5D
LEVEL = 6
#: Digests of repeated payloads that are broadcast at most: about 20 MB in memory.
BROADCAST_KEEPERS = 200_000


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. A revisit holds the HTTP header only, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = 65_536) -> bytes:
    """A dictionary from an even choice of the records; the beginnings of these where there is too little to train on."""
    every = max(1, sum(map(len, records)) // (16 * size))
    sample = [r for r in records[::every] if len(r) >= 8]
    if len(sample) >= 16 and sum(map(len, sample)) >= 8 * size:
        return zstandard.train_dictionary(size, sample).as_bytes()
    return b"".join(r[:512] for r in sample)[:size] or VERSION * 2


def frames(records: list[bytes], dictionary_bytes: int = 65_536) -> Iterator[bytes]:
    """An archive, part by part: the dictionary in a skippable frame, then a frame for each record."""
    data = dictionary(records, dictionary_bytes)
    own = zstandard.ZstdCompressionDict(data)
    own.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_checksum=True)
    yield struct.pack("<II", DICTIONARY_FRAME, len(data)) + data
    yield from map(compressor.compress, records)


def pack(records: list[bytes], dictionary_bytes: int = 65_536) -> bytes:
    """A whole archive."""
    return b"".join(frames(records, dictionary_bytes))


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, uncompressed, in order."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    view, at = memoryview(archive), 8 + size
    while at < len(archive):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + 65_536]
            if not chunk:
                raise ValueError("the last record is cut off")
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """The fields of a record; a response's payload is tested against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if first.encode() + b"\r\n" != VERSION or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't fit its digest")
    number = lambda v: int(x) if (x := v.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest,
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri).replace("s3a://", "s3://", 1))


def plan(pages: DataFrame, revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_keepers: int = BROADCAST_KEEPERS) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to.

    Payloads that occur several times are found by digest and id alone. Up to `broadcast_keepers` of them are broadcast, so that no payload is moved; beyond that
    the pages are joined by digest, where those too small to be revisits get keys of their own and adaptive execution splits what one payload holds.
    """
    common.small_batches(pages.sparkSession)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= revisit_bytes
    keepers = base.filter(large).groupBy(F.col("digest").alias("same")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("same", "keeper")
    keepers = common.written(keepers, "warc-keepers")
    if keepers.limit(broadcast_keepers + 1).count() <= broadcast_keepers:
        joined = base.join(F.broadcast(keepers), large & (base.digest == keepers.same), "left")
    else:
        key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "digest").cast("string")))
        joined = base.withColumn("key", key).join(keepers.hint("merge"), F.col("key") == F.col("same"), "left")
    revisit = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write(planned: DataFrame, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 8 << 20, tag: str = "warc") -> DataFrame:
    """Write archives to the shared folder; the manifest: path, n_records, n_bytes. A task holds the records of one archive."""
    spark = planned.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(common.shared_path(spark, tag))
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = filesystem(folder)
        fs.create_dir(where)
        records: list[bytes] = []

        def flush() -> pa.RecordBatch:
            name, n = f"{uuid.uuid4().hex}.warc.zst", 0
            with fs.open_output_stream(f"{where}/{name}", compression=None) as out:
                for frame in frames(records):
                    out.write(frame)
                    n += len(frame)
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([n], pa.int64())], ["path", "n_records", "n_bytes"])
            records.clear()
            common.released()
            return row

        size = 0
        for batch in common.pieces(batches, "payload", 1 << 20):
            for r in batch.to_pylist():
                records.append(record(r["record_type"], r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush()
                    size = 0
        if records:
            yield flush()

    return common.written(planned.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of all archives of a manifest, an archive a task at most. payload=False: all are read and tested just so, but only their fields are returned."""
    types = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(types + [("payload", pa.binary())] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, where = filesystem(uri)
                with fs.open_input_stream(where, compression=None) as f:
                    archive = f.read()
                rows, size = [], 0
                for data in unpack(archive):
                    row = parse(data)
                    if not payload:
                        del row["payload"]
                    rows.append(row)
                    size += len(data)
                    if size >= 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                del archive
                common.released()

    return manifest.repartition(max(1, min(manifest.count(), 100_000))).mapInArrow(run, RECORD + ", payload binary" * payload)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(write(plan(common.table(spark, sf_dir, "pages"))), payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
