"""Prefix trie of conversations, merged family first.

Conversations whose ids share a base (id - id mod `family`) are a family: each is rebuilt from the first h turns of the base's conversation and its own turns after the first h, where
h is the crc32 of its id mod `spread`. Turns travel as 128-bit digests of role and text with the text's size; texts are never shuffled. A family's turns meet in one task, sorted, where
they are read as a stream: the rebuilt conversations enter the family's own small trie, and only its nodes go on. A node is named by a digest of its path, so equal nodes of
different families meet by a plain aggregation.

What a node needs of its subtree are sums over its members, so that no level waits for another: every node belongs to its smallest member, a conversation's own nodes are
the last ones of its path, and a subtree's nodes are those that its members own, except that the node's owner has all from the node on. Hot nodes (the root, a first turn that a
third of all conversations share) are added up in parts; the ids that end at a node are hashed as a stream of sorted pieces.

Edge cases: null roles and texts are empty; null turns come first; equal turns of a conversation are ordered by their digests, and rows that repeat are turns of their own; rows
without conv_id belong to no conversation and are left out; negative ids have the next lower multiple of `family` as base; an absent base gives no turns; a rebuilt conversation may be
without turns and ends at the root; conversations of any length are streamed (a family's trie of more than `held` nodes is sent in parts); an empty table gives an empty result (there is
no root without a member); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

FAMILY, SPREAD = 5, 9
HELD = 20_000
#: Ids of a piece of those that end at a node: an interval of so many.
PIECE = 4096
ROOT = bytes(16)
NODE = ["na", "nb"]


def turns(conversations: DataFrame, family: int = FAMILY, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """base, conv_id, turn, sig (16 bytes), size (of the text): a row for each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    sig = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    own = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), sig.alias("sig"), F.octet_length(text).cast("long").alias("size"))
    return own.filter("conv_id IS NOT NULL").select((F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("base"), "*")


def lead(conv_id: int, spread: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % spread


class Family:
    """The trie of one family, or of a part of it, and the conversation that is being read."""

    def __init__(self, spread: int):
        self.spread, self.base, self.opening, self.nodes = spread, None, [], {}
        self.conv: int | None = None

    def visit(self) -> list:
        entry = self.nodes.get(self.node)
        if entry is None:
            entry = self.nodes[self.node] = [self.parent, self.depth, self.prefix, self.size, [], []]
        return entry

    def step(self, sig: bytes, size: int) -> None:
        self.parent, self.node = self.node, hashlib.blake2b(self.node + sig, digest_size=16).digest()
        self.depth, self.prefix, self.size = self.depth + 1, self.prefix + self.size, size
        self.visit()[4].append(self.conv)

    def begin(self, base: int, conv: int) -> None:
        if base != self.base:
            self.base, self.opening = base, []
        self.conv, self.at, self.skip = conv, 0, lead(conv, self.spread)
        self.node, self.parent, self.depth, self.prefix, self.size = ROOT, ROOT, 0, 0, 0
        self.visit()[4].append(conv)
        if conv != base:
            for sig, size in self.opening[: self.skip]:
                self.step(sig, size)

    def add(self, sig: bytes, size: int) -> None:
        if self.conv == self.base:
            if len(self.opening) < self.spread - 1:
                self.opening.append((sig, size))
            self.step(sig, size)
        elif self.at >= self.skip:
            self.step(sig, size)
        self.at += 1

    def end(self) -> None:
        if self.conv is not None:
            self.visit()[5].append(self.conv)
            self.conv = None

    def rows(self) -> list[tuple]:
        out = [(*struct.unpack("<qq", node), *struct.unpack("<qq", e[0]), *e[1:]) for node, e in self.nodes.items()]
        self.nodes = {}
        return out


FAMILY_NODES = pa.schema([(c, pa.int64()) for c in ("na", "nb", "pa", "pb", "depth", "prefix", "size")] + [("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def family_nodes(own: DataFrame, spread: int = SPREAD, held: int = HELD) -> DataFrame:
    """The nodes of all families' tries: na, nb (the node), pa, pb (its parent), depth, prefix (bytes of the texts before the last), size (of the last text), members, ends (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, out = Family(spread), []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FAMILY_NODES, strict=True)], schema=FAMILY_NODES)
            out.clear()
            return made

        for part in batches:
            for base, conv, sig, size in zip(*(part.column(c).to_pylist() for c in ("base", "conv_id", "sig", "size")), strict=True):
                if conv != family.conv:
                    family.end()
                    if base != family.base:
                        out += family.rows()
                    family.begin(base, conv)
                family.add(sig, size)
                if len(family.nodes) >= held:
                    out += family.rows()
                if len(out) >= 4096:
                    yield batch()
        family.end()
        out += family.rows()
        if out:
            yield batch()

    sorted_ = own.repartition("base").sortWithinPartitions("base", "conv_id", F.asc_nulls_first("turn"), "sig")
    kinds = ", ".join(f"{f.name} {'array<long>' if pa.types.is_list(f.type) else 'long'}" for f in FAMILY_NODES)
    return sorted_.mapInArrow(run, kinds)


def ends_digest(families: DataFrame) -> DataFrame:
    """na, nb, ends_sha256: of the ids that end at each node, in order, joined by commas. Pieces are built everywhere; a node's pieces are then only streamed through its hash."""
    ends = families.select(*NODE, F.explode("ends").alias("id")).withColumn("piece", F.floor(F.col("id") / PIECE))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy(*NODE, "piece").agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            a, b, digests = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digests)], [*NODE, "ends_sha256"])

        for part in batches:
            for a, b, ids in zip(*(part.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if (a, b) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= 4096:
                yield batch()
        if now is not None:
            out.append((*now, state.hexdigest()))
            yield batch()

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(run, "na long, nb long, ends_sha256 string")


def name(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def trie(conversations: DataFrame, family: int = FAMILY, spread: int = SPREAD, held: int = HELD, **columns) -> DataFrame:
    """A row for each node: node and parent (digests of their paths; the root has no parent), conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_ends (members that
    end there), n_children, n_leaves (childless nodes of its subtree), saved_tokens (bytes of last texts that the subtree's members share), ends_sha256."""
    common.small_batches(conversations.sparkSession)
    families = common.written(family_nodes(turns(conversations, family, **columns), spread, held), "family-nodes")
    merged = families.groupBy(*NODE).agg(
        F.sum(F.size("members")).alias("n_convs"), F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("ends")).alias("n_ends"), *(F.min(c).alias(c) for c in ("pa", "pb", "depth", "prefix", "size"))
    )
    nodes = common.written(merged, "trie-nodes")
    # of each conversation: what its own nodes hold, where they begin, and whether the last of them is a leaf (a node where all members end)
    owners = nodes.groupBy("conv_id").agg(F.sum("size").alias("own"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"), F.min("depth").alias("first"))
    whole = families.select(F.explode("ends").alias("id"), (F.col("prefix") + F.col("size")).alias("whole"))
    none = F.lit(0).cast("long")
    scalars = whole.join(owners, F.col("id") == F.col("conv_id"), "left").select("id", "whole", F.coalesce("own", none).alias("own"), F.coalesce("leaf", none).alias("leaf"), "first")
    members = families.select(*NODE, F.explode("members").alias("id")).join(scalars, "id")
    sums = members.groupBy(*NODE).agg(F.sum("whole").alias("whole"), F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"), *(F.min_by(c, "id").alias(f"owner_{c}") for c in ("whole", "own", "first")))
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("na"), F.col("pb").alias("nb")).agg(F.count("*").alias("n_children"))
    full = nodes.join(sums, NODE).join(children, NODE, "left").join(ends_digest(families), NODE, "left")
    saved = F.col("whole") - F.col("n_convs") * F.col("prefix") - (F.col("own") - F.col("owner_own") + F.col("owner_whole") - F.col("prefix"))
    full = full.select(*NODE, "pa", "pb", "conv_id", "depth", "n_convs", "n_ends", F.coalesce("n_children", none).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("owner_first").alias("first"))
    full = common.written(full, "trie")
    common.drop_written(families)
    common.drop_written(nodes)
    # below a conversation's first own node the parent is its own as well; only the first ones look theirs up
    own = F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id")
    inner = full.filter("depth = 0 OR depth > first").select("*", own)
    above = full.select(F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    first = full.filter("depth > 0 AND depth = first").join(above, ["pa", "pb"])
    both = inner.unionByName(first)
    return both.select(name(*NODE).alias("node"), F.when(F.col("depth") > 0, name("pa", "pb")).alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations")).select(*COLUMNS)


SQL = """
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, octet_length(encode(coalesce(text, ''))) AS b, substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32) AS sig FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, b, sig, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sig) AS i FROM t),
n AS (SELECT c, count(*) AS k FROM o GROUP BY c),
bits AS (SELECT k, 0 AS s, k AS v FROM range(256) r(k) UNION ALL SELECT k, s + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE s < 8),
tab AS (SELECT list(v ORDER BY k) AS l FROM bits WHERE s = 8),
crc AS (SELECT c, 0 AS s, 4294967295 AS v FROM n UNION ALL SELECT c, s + 1, xor(v >> 8, l[(xor(v, ascii(substr(CAST(c AS VARCHAR), s + 1, 1))) & 255) + 1]) FROM crc, tab WHERE s < length(CAST(c AS VARCHAR))),
h AS (SELECT c, c - (c % 5 + 5) % 5 AS base, xor(v, 4294967295) % 9 AS h FROM crc WHERE s = length(CAST(c AS VARCHAR))),
f AS (SELECT h.c, o.i AS d, sig, b FROM h JOIN o ON o.c = h.base AND o.i <= h.h
  UNION ALL SELECT h.c, least(h.h, coalesce(n.k, 0)) + o.i - h.h, sig, b FROM h JOIN o ON o.c = h.c AND o.i > h.h LEFT JOIN n ON n.c = h.base),
p AS (SELECT c, d, b, sha256(string_agg(sig, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node FROM f UNION ALL SELECT c, 0, 0, 'root' FROM h),
z AS (SELECT c, max(d) AS last FROM p GROUP BY c),
g AS (SELECT node, min(p.c) AS conv_id, max(d) AS depth, max(b) AS b, count(*) AS n_convs, count(*) FILTER (d = last) AS n_ends, sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (d = last), '')) AS ends FROM p JOIN z ON z.c = p.c GROUP BY node),
up AS (SELECT DISTINCT x.node, y.node AS parent FROM p x JOIN p y ON y.c = x.c AND y.d = x.d - 1),
kids AS (SELECT parent AS node, count(*) AS n FROM up GROUP BY parent),
sub AS (SELECT DISTINCT x.node, y.node AS below FROM p x JOIN p y ON y.c = x.c AND y.d >= x.d),
s AS (SELECT sub.node, CAST(sum((w.n_convs - 1) * w.b) AS BIGINT) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM sub JOIN g w ON w.node = sub.below LEFT JOIN kids ON kids.node = sub.below GROUP BY sub.node)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, g.n_convs, coalesce(kids.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN s ON s.node = g.node LEFT JOIN up ON up.node = g.node LEFT JOIN g a ON a.node = up.parent LEFT JOIN kids ON kids.node = g.node
"""
