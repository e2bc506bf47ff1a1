"""Ranked lexical search: block-max search over shards whose posting blocks have variable length.

Items are worked on in blocks of `block_bytes` of item text; a block's terms are broadcast. One pass over the documents' whole texts writes shards (the postings of the block's terms in
some `shard_bytes` of text, and every document's length); counts over all shards give N, L and df, so that scores are those of one index over everything. In each shard, dynamic
programming cuts each term's postings into blocks: it minimises the sum of (block maximum - impact) over all documents that blocks span plus `block_cost` for each block. The search adds the terms'
block maxima along the documents, which is WAND's pivot test for all documents at once: runs of documents whose bound is below the item's threshold are skipped, the others are
scored exactly, best bound first, and scores raise the threshold, which a task keeps from shard to shard. A task sends `most` rows an item; these meet in a ranking by item.

The score is in whole numbers: weight = floor(1000 ln((2N+2) / (2df+1))), m = 75 + (25 n N) div L, and a posting's impact is (1e9 tf) div (1000 tf + 12 m).

Edge cases: null or empty texts and texts without terms are no documents (they count in no figure); documents are rows, so rows that repeat an id are documents of their own; equal
scores rank by id, a null id first; items are distinct (id, text), so rows that repeat both are one item; an item without terms, or whose terms no document holds, has no rows;
a term that an item repeats counts as often; texts of any length are read whole, in slices; no documents or no items give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

MOST = 20
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 32 << 20
SLICE = 1 << 20
#: What a block costs, in units of impact (a posting's impact is below a million), and its most postings.
BLOCK_COST, LONGEST = 3_000_000, 64
#: Lists whose blocks are cut at the same time.
TOGETHER = 4096
#: Terms are runs of digits, letters and all that is not ASCII; other bytes become spaces.
TABLE = bytes(b if chr(b).isascii() and chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)).lower()


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, in lists of some megabyte of text."""
    spaced, at = text.translate(TABLE), 0
    while at < len(spaced):
        end = spaced.find(b" ", at + SLICE) if len(spaced) - at > SLICE else -1
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def counted(text: bytes, numbers: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """How many terms a text has, and how often it holds those that have numbers."""
    n, held = 0, Counter()
    for terms in slices(text):
        n += len(terms)
        held.update(map(numbers.get, terms))
    del held[None]
    return n, held


SHARD = "n_docs long, n_terms long, terms array<int>, dfs array<long>, ids array<long>, sizes binary, docs binary, tfs binary"


def shards(docs: DataFrame, numbers, shard_bytes: int) -> DataFrame:
    """A row for each shard, as a written table. numbers: a broadcast dict of terms. Postings are sorted by term and place; ids and sizes are of the documents that have postings."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split(" ")[0] for x in SHARD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        n_docs = n_terms = seen = 0
        ids, sizes, terms, places, tfs = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            t, p, f = (np.concatenate([np.array(x, np.uint32) for x in y]) if y else np.zeros(0, np.uint32) for y in (terms, places, tfs))
            order = np.argsort(t, kind="stable")
            own, dfs = np.unique(t, return_counts=True)
            row = [n_docs, n_terms, own.astype(np.int32), dfs.astype(np.int64), list(ids), np.array(sizes, np.int64).tobytes(), p[order].tobytes(), f[order].tobytes()]
            for x in (ids, sizes, terms, places, tfs):
                x.clear()
            common.released()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in common.pieces(batches):
            data, offsets = common.utf8(batch.column("text"))
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                n, held = counted(data[offsets[row] : offsets[row + 1]], known)
                if n:
                    n_docs, n_terms = n_docs + 1, n_terms + n
                if held:
                    terms.append(list(held))
                    tfs.append(list(held.values()))
                    places.append(np.full(len(held), len(ids), np.uint32))
                    ids.append(doc_id)
                    sizes.append(n)
            seen += len(data)
            if seen >= shard_bytes:
                yield flush()
                n_docs = n_terms = seen = 0
        if n_docs:
            yield flush()

    return common.written(docs.mapInArrow(run, SHARD), "search-shards")


def cut(docs: np.ndarray, impacts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cost: int = BLOCK_COST, longest: int = LONGEST) -> np.ndarray:
    """Where blocks begin, as marks on the joined lists: for each list the cut with the least sum of (block maximum) * (documents it spans) + cost a block. All lists advance together."""
    marks = np.zeros(len(impacts), bool)
    longest = int(min(longest, sizes.max(initial=1)))
    by_size = np.argsort(-sizes, kind="stable")
    for group in range(0, len(sizes), TOGETHER):
        own = by_size[group : group + TOGETHER]
        first, n = starts[own], sizes[own]
        # of each list, for a last block of 1, 2, ... postings: its first document, the greatest impact in it, and the least cost of all before it
        begin, top = np.zeros((2, len(own), longest), np.int64)
        before = np.full((len(own), longest), np.iinfo(np.int64).max // 4, np.int64)
        now, back = np.zeros(len(own), np.int64), np.zeros(int(n.sum()), np.int16)
        place = np.append(0, np.cumsum(n)[:-1])
        for j in range(int(n[0])):
            a = int(np.searchsorted(-n, -j, "left"))  # lists with more than j postings come first
            begin, top, before = begin[:a], top[:a], before[:a]
            s, doc = impacts[first[:a] + j], docs[first[:a] + j]
            begin[:, 1:] = begin[:, :-1]
            begin[:, 0] = doc
            top[:, 1:] = top[:, :-1]
            top[:, 0] = 0
            np.maximum(top, s[:, None], out=top)
            before[:, 1:] = before[:, :-1]
            before[:, 0] = now[:a]
            total = top * (doc[:, None] + 1 - begin) + before
            best = total.argmin(1)
            now[:a] = total[np.arange(a), best] + cost
            back[place[:a] + j] = best + 1
        at = n.copy()
        while len(live := np.flatnonzero(at > 0)):
            at[live] -= back[place[live] + at[live] - 1]
            marks[first[live] + at[live]] = True
    return marks


class Shard:
    """The postings of a shard with their impacts and blocks."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, cost: int):
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.docs, tfs = np.frombuffer(row["docs"], np.uint32).astype(np.int64), np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
        m = 75 + 25 * sizes * n_docs // n_terms
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[self.docs])
        self.n, dfs = len(sizes), np.array(row["dfs"], np.int64)
        starts = np.cumsum(dfs) - dfs
        self.lists = {t: (a, a + k) for t, a, k in zip(row["terms"], starts.tolist(), dfs.tolist(), strict=True)}
        self.blocks = np.flatnonzero(cut(self.docs, self.impacts, starts, dfs, cost))  # a block begins at each
        self.tops = np.maximum.reduceat(self.impacts, self.blocks) if len(self.blocks) else np.zeros(0, np.int64)
        ends = np.append(self.blocks[1:], len(self.docs)) - 1
        self.firsts, self.lasts = self.docs[self.blocks], self.docs[ends]

    def bounds(self, query: list[tuple[int, int]]) -> np.ndarray:
        """For each document, the sum of the maxima of the blocks that span it."""
        steps = np.zeros(self.n + 1, np.int64)
        for t, w in query:
            a, b = self.lists[t]
            i, j = np.searchsorted(self.blocks, (a, b))
            top = self.tops[i:j] * w
            steps[self.firsts[i:j]] += top
            steps[self.lasts[i:j] + 1] -= top
        return np.cumsum(steps[:-1])

    def scores(self, query: list[tuple[int, int]], docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t, w in query:
            a, b = self.lists[t]
            own = self.docs[a:b]
            at = np.minimum(np.searchsorted(own, docs), b - a - 1)
            out += np.where(own[at] == docs, self.impacts[a + at] * w, 0)
        return out


class Best:
    """The best documents of an item so far: score, whether there is an id, id."""

    def __init__(self, most: int):
        self.most, self.rows = most, np.zeros((0, 3), np.int64)

    @property
    def least(self) -> int:
        """No score below it can enter."""
        return int(self.rows[-1, 0]) if len(self.rows) >= self.most else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.column_stack([scores, ids])[scores >= self.least]])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.most]]


def search(shard: Shard, ids: np.ndarray, query: list[tuple[int, int]], best: Best) -> int:
    """Add what the shard has to the best of an item; the number of documents that were scored. query: terms of the shard and their weights, all above zero."""
    bounds, done, step = shard.bounds(query), 0, 4 * best.most
    open_ = np.flatnonzero(bounds >= best.least)
    open_ = open_[np.argsort(-bounds[open_], kind="stable")]
    while done < len(open_) and bounds[open_[done]] >= best.least:
        docs = np.sort(open_[done : done + step])
        docs = docs[bounds[docs] >= best.least]
        best.add(shard.scores(query, docs), ids[docs])
        done, step = done + step, 2 * step
    return min(done, len(open_))


def ranked(docs: DataFrame, items: list[tuple], most: int, shard_bytes: int, cost: int) -> tuple[DataFrame, DataFrame] | None:
    """item (its place in items), doc_id, score: the best rows of each task; and the shards that they are read from. items: (id, text); None if there is nothing to find."""
    spark = docs.sparkSession
    terms = [Counter(t for part in slices((text or "").encode()) for t in part) for _, text in items]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
    found = shards(docs, spark.sparkContext.broadcast(numbers), shard_bytes)
    n_docs, n_terms = found.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs or not numbers:
        return None
    dfs = found.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).toArrow()  # no more rows than the block has terms
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in zip(*(c.to_pylist() for c in dfs.columns), strict=True)}
    queries = [[(numbers[t], weights[numbers[t]] * k) for t, k in own.items() if weights.get(numbers[t], 0) > 0] for own in terms]
    shared = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = row.column("ids").flatten()
                ids = np.column_stack([own.is_valid().to_numpy(False), own.fill_null(0).to_numpy()]).astype(np.int64)
                row = {c: row.column(c)[0].as_py() for c in ("sizes", "docs", "tfs", "terms", "dfs")}
                shard = Shard(row, n_docs, n_terms, cost)
                for query, top in zip(shared.value, best, strict=True):
                    if here := [(t, w) for t, w in query if t in shard.lists]:
                        search(shard, ids, here, top)
                del shard, row, own, ids
                common.released()
        for item, top in enumerate(best):
            if len(top.rows):
                score, held, doc = (pa.array(c) for c in top.rows.T.copy())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item, np.int32)), pa.compute.if_else(pa.compute.equal(held, 1), doc, pa.scalar(None, pa.int64())), score], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item int, doc_id long, score long"), found


def rank(
    documents: DataFrame, items: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, block_cost: int = BLOCK_COST,
) -> DataFrame:
    """item_id, rank int, doc_id, score: the `most` best documents of each item."""
    docs, spark = common.documents(documents, id_col, text_col), documents.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    kind = own.schema["item_id"].dataType.simpleString()
    own = common.written(own.withColumn("at", F.xxhash64("item_id", "text")), "search-items")
    total = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks, out = 1 + total // block_bytes, []
    for block in range(blocks):
        rows = [(r.item_id, r.text) for r in own.filter(F.pmod("at", F.lit(blocks)) == block).collect()]
        found = ranked(docs, rows, most, shard_bytes, block_cost) if rows else None
        if found is None:
            continue
        found, held = found
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
        best = found.withColumn("rank", place).filter(F.col("rank") <= most)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(rows)], f"item int, item_id {kind}")
        out.append(common.written(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-best"))
        common.drop_written(held)
    common.drop_written(own)
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT q, t, count(*) AS k FROM (SELECT q, unnest(w) AS t FROM i) GROUP BY q, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
ws AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
ms AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, g),
s AS (SELECT q, doc_id, r, CAST(sum(k * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM qt JOIN ws USING (t) JOIN p USING (t) JOIN ms USING (r) GROUP BY q, doc_id, r),
x AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rn FROM s WHERE score > 0)
SELECT item_id, CAST(rn AS INTEGER) AS rank, doc_id, score FROM x JOIN i USING (q) WHERE rn <= 20
"""
