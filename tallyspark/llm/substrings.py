"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts anywhere else, in any document.

1. Each text is sieved for anchors (see sieve.py): equal strings have equal anchors, so only regions around anchors that occur twice can hold
   repeated strings. A region is all bytes that strings with this anchor can cover.
2. A region whose whole content occurs again is repeated throughout; that is found by its hash.
3. The other regions of anchors that occur again go to shards by anchor. A shard's suffix array (Larsson-Sadakane) and common prefixes (Kasai) tell which
   strings start elsewhere. One region stands for all with equal content.
4. An anchor with more than `hot_regions` different regions is dealt over several shards. The strings of each shard are merged across
   shards by binary search in sorted arrays of their hashes.
5. The covered bytes are cut out of each document.

Strings are judged on the input, all at once. Matches are of UTF-8 bytes and never cross documents.

Edge cases: null texts count as empty; texts shorter than `length` keep everything; every input row is a document of its own, so rows that repeat an id or a
text repeat each other's strings; a null id is an id like any other; texts of any length are read whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, sieve
from tallyspark.llm.suffix_array import Regions, merged

LENGTH = 400
HOT_REGIONS = 4000
SHARD_BYTES = 1 << 20
MERGE_STRINGS = 500_000


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h, text. Equal rows share (doc_id, h); what is found for one holds for the other."""
    return common.documents(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of substrings, as two rows of 64 bits: equal ones are taken for equal bytes."""
    view = memoryview(data)
    made = b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(starts.tolist(), ends.tolist())])
    return np.ascontiguousarray(np.frombuffer(made, np.int64).reshape(-1, 2).T)


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each anchor and content of its region in a document: doc_id, h, fp, r, q (128-bit digest of the region), a, b (its bounds), n (how often it is there).

    Rows with a null fp are stretches [a, b) that repeat within their document.
    """
    names = ["doc_id", "h", "fp", "r", "q", "a", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            data, offsets = common.utf8(batch.column("text"))
            hashes = sieve.Hashes(np.frombuffer(data, np.uint8))
            at, fp, doc = sieve.anchors(hashes, offsets, length, gram)
            if not len(at):
                continue
            a, b = np.maximum(at - (length - gram), offsets[doc]), np.minimum(at + length, offsets[doc + 1])
            r, q = digests(data, a, b)
            found = pd.DataFrame({"doc": doc, "fp": fp.view(np.int64), "r": r, "q": q, "a": a - offsets[doc], "b": b - offsets[doc]})
            by = ["doc", "fp", "r", "q"]
            found["n"] = found.groupby(by)["a"].transform("size")
            again = found[found["n"] > 1]
            found = found.drop_duplicates(by)
            stretches = []
            for d, own in again.groupby("doc"):
                s, e = merged(own["a"].to_numpy(), own["b"].to_numpy())
                none = pd.array([pd.NA] * len(s), "Int64")  # left out, they would turn the column's hashes into doubles, which are not exact
                stretches.append(pd.DataFrame({"doc": d, "fp": none, "r": none, "q": none, "a": s, "b": e, "n": 2}))
            out = pd.concat([found.astype({"fp": "Int64", "r": "Int64", "q": "Int64"}), *stretches]) if stretches else found
            index = pa.array(out["doc"].to_numpy())
            whole = [pa.array(out[c].astype("Int64")) for c in names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(index), batch.column("h").take(index), *whole], names)

    return docs.mapInArrow(run, "doc_id long, h long, fp long, r long, q long, a long, b long, n long")


def regions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, h, a, b and more) with the bytes of each region. A document's regions are as many as its anchors at most."""
    rest = [c for c in wanted.columns if c not in ("doc_id", "h")]
    lists = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h")).agg(F.collect_list(F.struct(*rest)).alias("regions"))
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("doc_id", "h", "text", "regions")
    fields = {f.name: f for f in wanted.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            data, offsets = common.utf8(batch.column("text"))
            lists = batch.column("regions")
            counts = np.asarray(pa.compute.list_value_length(lists), np.int64)
            flat = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), counts)
            a, b = (np.asarray(flat.field(c)) + offsets[doc] for c in ("a", "b"))
            index = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(index), batch.column("h").take(index), *(flat.field(c) for c in rest), pa.array([data[s:e] for s, e in zip(a.tolist(), b.tolist())], pa.binary())], ["doc_id", "h", *rest, "bytes"])

    return joined.mapInArrow(run, "doc_id long, h long, " + "".join(f"{c} {fields[c].dataType.simpleString()}, " for c in rest) + "bytes binary")


def stitched(group: pd.DataFrame) -> list[tuple[list, bytes]]:
    """A document's overlapping regions united: the rows' positions and the joint bytes, for each stretch."""
    out: list[tuple[list, list, int]] = []
    for i, a, b, data in zip(range(len(group)), group["a"], group["b"], group["bytes"]):
        if out and a < out[-1][2]:
            rows, parts, end = out[-1]
            rows.append(i)
            if b > end:
                parts.append(data[end - a :])
                out[-1] = (rows, parts, b)
        else:
            out.append(([i], [data], b))
    return [(rows, b"".join(parts)) for rows, parts, _ in out]


def shard(length: int, merges: int):
    """For one shard: the stretches that are repeated in it (kind 0), and the different strings of hot anchors (kind 1; keys, places, documents)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "h", "a", "b"], kind="stable").reset_index(drop=True)
        strings, rows = [], []
        for _, group in pdf.groupby(["doc_id", "h"], dropna=False, sort=False):
            first = group.index[0]
            for own, data in stitched(group):
                strings.append(data)
                rows.append([first + i for i in own])
        built = Regions(strings)
        again = built.repeated(length)
        spans, open_ = [], []
        a_all, b_all, hot = (pdf[c].to_numpy() for c in ("a", "b", "hot"))
        whole = built.data.tobytes() if hot.any() else b""
        for k, members in enumerate(rows):
            base, start = a_all[members[0]], built.starts[k]
            hits = np.flatnonzero(again[start : start + built.sizes[k]])
            s, e = merged(hits, hits + length)
            row = members[0]
            spans += [(row, x + base, y + base) for x, y in zip(s.tolist(), e.tolist())]
            for m in members:
                if hot[m]:
                    lo, hi = int(a_all[m] - base), int(b_all[m] - base)
                    each = np.arange(lo, hi - length + 1)
                    open_.append((digests(whole, start + each, start + each + length).T.copy().view("V16")[:, 0], each + base, again[start + each], np.full(len(each), m)))
        ids = pdf["doc_id"]
        out = [(0, ids.iat[r], pdf["h"].iat[r], int(a), int(b), 0, None) for r, a, b in spans]
        if open_:
            keys, places, known, member = (np.concatenate(x) for x in zip(*open_))
            one = np.zeros(len(keys), bool)  # of a string that is repeated here, one place goes on to meet other shards
            at = np.flatnonzero(known)
            one[at[np.unique(keys[at], return_index=True)[1]]] = True
            keep = ~known | one
            keys, places, member = keys[keep], places[keep], member[keep]
            two = np.frombuffer(keys.tobytes(), np.int64).reshape(-1, 2)
            bucket = (two.view(np.uint64)[:, 0] >> np.uint64(32)).astype(np.int64) % merges
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])).tolist() + [len(by)] if len(by) else []
            id_values, nulls, h_values = ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(), pdf["h"].to_numpy(np.int64)
            for x, y in zip(cuts, cuts[1:]):
                part = by[x:y]
                m = member[part]
                out.append((1, None, 0, 0, 0, int(bucket[part[0]]), np.stack([two[part, 0], two[part, 1], places[part], id_values[m], h_values[m], nulls[m].astype(np.int64)]).tobytes()))
        del built, again, strings
        common.released()
        return pd.DataFrame(out, columns=["kind", "doc_id", "h", "a", "b", "bucket", "strings"]).astype({"doc_id": "Int64", "h": "int64", "a": "int64", "b": "int64", "bucket": "int64"})

    return run


SHARD_OUT = "kind int, doc_id long, h long, a long, b long, bucket long, strings binary"


def across(length: int):
    """The strings of hot anchors, of all shards: those whose digest another place has, too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = pd.DataFrame(np.concatenate([np.frombuffer(x, np.int64).reshape(6, -1) for x in pdf["strings"]], axis=1).T, columns=["key", "more", "place", "doc_id", "h", "null"])
        flat = flat.drop_duplicates()  # two anchors' regions may hold one string of a document
        several = flat.sort_values(["key", "more"], kind="stable").reset_index(drop=True)
        key, more = several["key"].to_numpy(), several["more"].to_numpy()
        same = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
        hit = several[np.append(same, False) | np.append(False, same)]
        out = []
        for (doc_id, h, null), own in hit.groupby(["doc_id", "h", "null"]):
            s, e = merged(own["place"].to_numpy(), own["place"].to_numpy() + length)
            out += [(None if null else doc_id, h, x, y) for x, y in zip(s.tolist(), e.tolist())]
        return pd.DataFrame(out, columns=["doc_id", "h", "a", "b"]).astype({"doc_id": "Int64", "h": "int64", "a": "int64", "b": "int64"})

    return run


def repeated_stretches(docs: DataFrame, length: int = LENGTH, gram: int | None = None, hot_regions: int = HOT_REGIONS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, h, a, b: stretches of bytes covered by strings that also start elsewhere; they may overlap."""
    gram = gram or max(1, min(sieve.GRAM, length * 3 // 5))
    found = common.written(anchored(docs, length, gram), "anchors")
    anchors = found.filter("fp IS NOT NULL")
    twice = anchors.groupBy(F.col("fp").alias("f")).agg(F.sum("n").alias("t")).filter("t > 1").select("f")
    common_anchors = common.written(anchors.join(twice, F.col("fp") == F.col("f")).drop("f").unionByName(found.filter("fp IS NULL")), "common-anchors")
    common.drop_written(found)
    stretches, anchors = common_anchors.filter("fp IS NULL").select("doc_id", "h", "a", "b"), common_anchors.filter("fp IS NOT NULL")
    contents = anchors.groupBy(F.col("fp").alias("f"), F.col("r").alias("r1"), F.col("q").alias("q1")).agg(F.sum("n").alias("c"))
    per_anchor = contents.groupBy(F.col("f").alias("g")).agg(F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("single"))
    counted = anchors.join(contents, (F.col("fp") == F.col("f")) & (F.col("r") == F.col("r1")) & (F.col("q") == F.col("q1"))).join(per_anchor, F.col("fp") == F.col("g")).select("doc_id", "h", "fp", "r", "q", "a", "b", "c", "kinds", "single")
    counted = common.written(counted, "counted-anchors")
    whole = counted.filter("c > 1").select("doc_id", "h", "a", "b")
    mixed = counted.filter("kinds > 1 AND single > 0")
    one_each = mixed.filter("c > 1").groupBy("fp", "r", "q", "kinds").agg(F.min(F.struct("doc_id", "h", "a", "b")).alias("s")).select("s.*", "fp", "r", "kinds")
    chosen = common.written(mixed.filter("c = 1").select("doc_id", "h", "a", "b", "fp", "r", "kinds").unionByName(one_each), "regions")
    hot = F.col("kinds") > hot_regions
    sums = chosen.agg(F.sum(F.col("b") - F.col("a")).alias("n"), F.sum(F.when(hot, F.col("b") - F.col("a") - (length - 1))).alias("strings")).first()
    total, strings = sums.n or 0, sums.strings or 0
    merges = max(1, -(-strings // MERGE_STRINGS))
    shards = max(1, -(-total // shard_bytes))
    part = F.when(hot, F.pmod(F.xxhash64("r"), F.ceil(F.col("kinds") / hot_regions))).otherwise(F.lit(0))
    placed = chosen.select("doc_id", "h", "a", "b", "fp", hot.alias("hot"), F.pmod(F.xxhash64("fp", part), F.lit(shards)).alias("shard"))
    sharded = common.written(regions(docs, placed).groupBy("shard").applyInPandas(shard(length, merges), SHARD_OUT), "shards")
    spans = sharded.filter("kind = 0").select("doc_id", "h", "a", "b").unionByName(stretches).unionByName(whole)
    if strings:
        spans = spans.unionByName(sharded.filter("kind = 1").groupBy("bucket").applyInPandas(across(length), "doc_id long, h long, a long, b long"))
    return spans


OUT = "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>"


def cut(data: bytes, offsets: np.ndarray, spans: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """What is left of each text without its spans (a list of a, b for each, or null), and the maximal runs taken out."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(spans), 0), np.int64)
    flat, n = spans.flatten(), len(offsets) - 1
    shift = offsets[:-1] + np.arange(n)  # texts one apart, so that runs of neighbours don't touch
    doc = np.repeat(np.arange(n), sizes)
    s, e = merged(*(np.asarray(flat.field(c), np.int64) + shift[doc] for c in ("a", "b")))
    doc = np.searchsorted(shift, s, "right") - 1
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, s - doc, 1)
    np.add.at(edges, e - doc, -1)
    stays = np.cumsum(edges[:-1]) == 0
    left = np.append(0, np.cumsum(stays))[offsets].astype(np.int64)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(left.tobytes()), pa.py_buffer(np.frombuffer(data, np.uint8)[stays].tobytes())]).cast(pa.binary())
    each = np.append(0, np.cumsum(np.bincount(doc, minlength=n))).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(s - shift[doc]), pa.array(e - shift[doc])], ["start", "end"])
    return kept, pa.ListArray.from_arrays(pa.array(each), runs)


def decoded(kept: pa.Array) -> pa.Array:
    """Bytes as text, without what is no UTF-8."""
    try:
        return kept.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="ignore") for x in kept.to_pylist()], pa.string())


def dedup(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decode: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that are left), removed (maximal runs taken out, in bytes of the input). keep: further columns to pass on.

    decode: kept is a string; the remainders of characters that a cut went through are left out.
    """
    docs = keyed(df, id_col, text_col)
    spans = repeated_stretches(docs, length, **options)
    lists = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    more = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep)).withColumn("h", F.xxhash64("text"))
    joined = more.join(lists, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").drop("s_id", "s_h", "h")
    extra = [f"keep_{c}" for c in keep]
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            data, offsets = common.utf8(batch.column("text"))
            kept, removed = cut(data, offsets, batch.column("spans"))
            if decode:
                kept = decoded(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), kept, removed, *(batch.column(c) for c in extra)], ["doc_id", "n_bytes", "kept", "removed", *keep])

    schema = OUT.replace("kept binary", "kept string") if decode else OUT
    return joined.mapInArrow(run, schema + "".join(f", `{c}` {kinds['keep_' + c]}" for c in keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
