"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least `percent` / 100, and the groups they form.

1. Every text gets the size of its set and a 128-bit signature of it; documents with equal signatures are one class.
2. Shingles are counted by hash range. Within a batch of texts a class counts once, and a shingle of more than OFTEN classes goes as one entry with its
   count, so no range grows with a shingle's frequency. One that only a single class holds cannot be shared, so a class goes on only if enough of its
   shingles are held twice. Different sets can link only if they share `percent` / (100 - percent) shingles at least (4), so smaller ones end here.
3. Sets are ordered globally, rarest shingle first. Two sets that link share a shingle of their prefixes (length bound of the prefix filter).
4. Each class has one home: the commonest shingle of its prefix, by ranges of length and in blocks where that has more than `block` holders; or their shingles are more than HOME_TOKENS;
   some holders (PIVOTS) go to all blocks of their shingle. The sets of a home go into a prefix tree once. A set walks the tree, shares the overlap counted for common
   paths, and leaves a subtree when the shingles still to come cannot lift any of its sets to the threshold, when lengths differ too much, or when the subtree
   holds no candidate outside its own group.
5. Then each class visits the homes of those that it shares another prefix shingle with and that are in another, larger group. Every pair that
   links and isn't in one group yet meets there. Nothing is joined by way of mere candidates.
6. The links found are tested on the shingles themselves. Should hashes of 48 bits have made a false one, all is done again with another seed. A false link needs two sets that almost
   link and a collision among their shingles: some n^2 / 2^48 for each such pair of n shingles, 0.004 over a billion pairs of a thousand.

Edge cases: null and empty texts and texts without words have no set (n_shingles 0) and link with nothing, component_id is their own id; a text of fewer
words than a shingle is one shingle; every input row gives one output row, and equal rows share their group; a null id never is a component_id unless all
ids of the group are null; texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.components import components
from tallyspark.llm.shingles import WORDS, exact, forget, shingles

PERCENT = 80
BLOCK = 2000
PIVOTS = 16
#: Shingles of a home, or of a part of all homes, of 8 bytes each; a single set may have more.
HOME_TOKENS = 4_000_000
OFTEN = 8
RANGE_BYTES = 6 << 20  # of text, for each range of hashes: about a million shingles
BATCH_BYTES = 6 << 20
BATCH_ROWS = 60_000  # places in a batch have 16 bits
SEEDS = 4

CLASS = ["n", "s1", "s2"]
LOW = np.uint64(16)
TOKEN = np.uint64((1 << 48) - 1)


def hashed(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t1, t2, text: equal rows, and only these, share the first three."""
    return common.documents(df, id_col, text_col).select("doc_id", *hashed(F.col("text")), "text")


def signed(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, t1, t2, n (size of the set), s1, s2 (its signature): a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            _, n, s1, s2 = shingles(*common.utf8(batch.column("text")), words, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], ["doc_id", "t1", "t2", *CLASS])
        forget()
        common.released()

    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, s1 long, s2 long")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _six(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u4").tobytes() + (tokens >> np.uint64(32)).astype("<u2").tobytes()


def _from_six(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _all(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def by_range(docs: DataFrame, words: int, ranges: int, seed: int) -> DataFrame:
    """The shingles of a batch of documents: part, batch, kind, a, b, c, d.

    kind 0, a range: a, b: tokens and the places of the classes that hold them; c, d: tokens of more than OFTEN classes, and of how many.
    kind 1, the batch: a, b: sizes and signatures of its classes, by place; c, d: the tokens of more than OFTEN classes and the places.
    """

    def packed(held: list[tuple], batch: int) -> Iterator[pa.RecordBatch]:
        tokens, n, s1, s2 = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((s2, s1, n))
        first = np.append(True, (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1]) | (n[order][1:] != n[order][:-1]))
        place = np.full(len(n), -1)
        chosen = np.sort(order[first])
        chosen = chosen[n[chosen] > 0]
        place[chosen] = np.arange(len(chosen))
        own = np.repeat(place, n)
        tokens, own = tokens[own >= 0] >> LOW, own[own >= 0].astype("<u2")
        order = np.argsort(tokens)
        tokens, own = tokens[order], own[order]
        cuts = _runs(tokens)
        times = np.diff(cuts)
        many = np.repeat(times, times) > OFTEN
        often, counts = tokens[cuts[:-1]][times > OFTEN], times[times > OFTEN]
        kept = [_six(tokens[many]), own[many].tobytes()]
        tokens, own = tokens[~many], own[~many]
        out = [(batch % ranges, batch, 1, n[chosen].astype("<i4").tobytes(), np.stack([s1[chosen], s2[chosen]]).tobytes(), *kept)]
        part, other = ((x >> LOW) * np.uint64(ranges) >> np.uint64(32) for x in (tokens, often))
        edges = np.unique(np.append(part, other))
        begin, end = np.searchsorted(part, edges), np.searchsorted(part, edges, "right")
        begin_, end_ = np.searchsorted(other, edges), np.searchsorted(other, edges, "right")
        for p, a, b, c, d in zip(edges.tolist(), begin.tolist(), end.tolist(), begin_.tolist(), end_.tolist()):
            out.append((p, batch, 0, _six(tokens[a:b]), own[a:b].tobytes(), _six(often[c:d]), counts[c:d].astype("<i4").tobytes()))
            if len(out) >= 256:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "batch", "kind", "a", "b", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n, made = [], 0, 0, 0
        number = TaskContext.get().partitionId() << 32
        for batch in common.pieces(batches):
            if held and n + batch.num_rows > BATCH_ROWS:
                yield from packed(held, number + made)
                held, size, n, made = [], 0, 0, made + 1
            data, offsets = common.utf8(batch.column("text"))
            held.append(shingles(data, offsets, words, seed))
            size, n = size + len(data), n + batch.num_rows
            if size >= BATCH_BYTES:
                yield from packed(held, number + made)
                held, size, n, made = [], 0, 0, made + 1
        if held:
            yield from packed(held, number + made)
        del held
        forget()
        common.released()

    return docs.select("text").mapInArrow(run, "part long, " + ROW)


ROW = "batch long, kind int, a binary, b binary, c binary, d binary"


def _column(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def counted(table: pa.Table) -> pa.Table:
    """For one hash range: each batch's tokens that several classes hold, as 16 bits of how many hold it, then 48 of its hash: their order is the global one."""
    own = table.filter(pa.compute.equal(table.column("kind"), 0))
    tokens, often = [_from_six(x) for x in _column(own, "a")], [_from_six(x) for x in _column(own, "c")]
    places, times = _column(own, "b"), [np.frombuffer(x, "<i4") for x in _column(own, "d")]
    joined = _all(tokens + often, np.uint64)
    weight = np.concatenate([np.ones(sum(map(len, tokens)), np.int64), *times]) if len(joined) else np.zeros(0, np.int64)
    order = np.argsort(joined)
    cuts = _runs(joined[order])
    held = np.empty(len(joined), np.int64)
    if len(joined):
        held[order] = np.repeat(np.add.reduceat(weight[order], cuts[:-1]), np.diff(cuts))
    ranked = np.minimum(held, 65_535).astype(np.uint64) << np.uint64(48) | joined
    keep, at, after, out = held > 1, 0, sum(map(len, tokens)), []
    for batch, mine, where, more in zip(_column(own, "batch"), tokens, places, often):
        use = keep[at : at + len(mine)]
        out.append((batch, 0, ranked[at : at + len(mine)][use].tobytes(), np.frombuffer(where, "<u2")[use].tobytes(), ranked[after : after + len(more)].tobytes(), b""))
        at, after = at + len(mine), after + len(more)
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    names = ["batch", "kind", "a", "b", "c", "d"]
    made = pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
    rest = table.filter(pa.compute.equal(table.column("kind"), 1)).select(names)
    common.released()
    return pa.concat_tables([made, rest.cast(made.schema)])


def survivors(percent: int):
    """For one batch: its classes that hold enough shared tokens, these in global order."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        about = table.filter(pa.array(kind == 1))
        a, b, c, d = (_column(about, x)[0] for x in "abcd")
        n, signatures = np.frombuffer(a, "<i4"), np.frombuffer(b, np.int64).reshape(2, -1).view(np.int64)
        own = table.filter(pa.array(kind == 0))
        often = np.sort(_all([np.frombuffer(x, np.uint64) for x in _column(own, "c")], np.uint64) << LOW)  # by hash; the count is dropped
        ranks = _all([np.frombuffer(x, np.uint64) for x in _column(own, "c")], np.uint64)
        ranks = ranks[np.argsort(ranks << LOW)]
        common_, places = _from_six(c), np.frombuffer(d, "<u2")
        tokens = np.concatenate([*(np.frombuffer(x, np.uint64) for x in _column(own, "a")), ranks[np.searchsorted(often, common_ << LOW)]])
        places = np.concatenate([*(np.frombuffer(x, "<u2") for x in _column(own, "b")), places])
        order = np.argsort(tokens)
        order = order[np.argsort(places[order], kind="stable")]
        tokens, places = tokens[order], places[order]
        cuts = _runs(places)
        at = places[cuts[:-1]].astype(np.int64)
        shared = np.diff(cuts)
        enough = np.flatnonzero((100 * shared >= percent * n[at].astype(np.int64)) & ((100 - percent) * shared >= percent))
        chosen = at[enough]
        sets = [tokens[cuts[i] : cuts[i + 1]].tobytes() for i in enough.tolist()]
        batch = about.column("batch")[0].as_py()
        common.released()
        return pa.table([pa.array(np.full(len(chosen), batch, np.int64)), pa.array(n[chosen].astype(np.int64)), pa.array(signatures[0][chosen]), pa.array(signatures[1][chosen]), pa.array(sets, pa.binary())], ["batch", *CLASS, "tokens"])

    return run


SET = "batch long, n long, s1 long, s2 long, tokens binary"


def prefix(n: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """How many of the shared tokens, in order, belong to the prefix; the n - shared others come before them."""
    return n - -(-percent * n // 100) + 1 - (n - shared)


class Tree:
    """A prefix tree of ordered sets given in lexicographic order; a node stands for the sets lo..hi and holds the tokens up to where they part."""

    __slots__ = ("start", "stop", "lo", "hi", "least", "most", "longest", "children")

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, lo: int, hi: int, start: int):
        self.lo, self.hi, self.start = lo, hi, start
        self.least, self.most = int(n[lo:hi].min()), int(n[lo:hi].max())
        self.longest = max(len(s) for s in sets[lo:hi])
        a, b = sets[lo], sets[hi - 1]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[start:short] != b[start:short])
        self.stop = start + int(differ[0]) if len(differ) else short
        self.children: list[Tree] = []

    def grow(self, sets: list[np.ndarray], n: np.ndarray) -> list[Tree]:
        """The children; sets that end here (lo first) are not among them."""
        i = self.lo
        while i < self.hi and len(sets[i]) == self.stop:
            i += 1
        while i < self.hi:
            j, token = i + 1, sets[i][self.stop]
            while j < self.hi and sets[j][self.stop] == token:
                j += 1
            self.children.append(Tree(sets, n, i, j, self.stop))
            i = j
        return self.children


def tree(sets: list[np.ndarray], n: np.ndarray) -> Tree:
    root = Tree(sets, n, 0, len(sets), 0)
    todo = [root]
    while todo:
        node = todo.pop()
        if node.hi - node.lo > 1:
            todo += node.grow(sets, n)
    return root


def links(sets: list[np.ndarray], n: np.ndarray, groups: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the given groups as far as they can be joined. sets: tokens in global order, all of one numbering; n: sizes with the tokens that nothing else holds."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
    sets, n, groups = [sets[i] for i in order], n[order], groups[order].copy()
    size = max(int(s.max()) for s in sets) + 1
    shared = np.array([len(s) for s in sets])
    heads = prefix(n, shared, percent)
    holders = np.repeat(np.arange(len(sets)), heads)
    tokens = np.concatenate([s[:h] for s, h in zip(sets, heads)])
    by = np.argsort(tokens, kind="stable")
    tokens, holders = tokens[by], holders[by]
    starts = np.searchsorted(tokens, np.arange(size + 1))
    root, mask, out = tree(sets, n), np.zeros(size, bool), []
    for x, own in enumerate(sets):
        near = [holders[starts[t] : starts[t + 1]] for t in own[: heads[x]].tolist()]
        todo = np.zeros(len(sets), bool)
        todo[np.concatenate(near)] = True
        todo[: x + 1] = False
        todo &= groups != groups[x]
        if not todo.any():
            continue
        before = np.append(0, np.cumsum(todo))
        mask[own] = True
        stack = [(root, 0)]
        while stack:
            node, overlap = stack.pop()
            if before[node.hi] == before[node.lo] or 100 * node.most < percent * n[x] or percent * node.least > 100 * n[x]:
                continue
            part = sets[node.lo][node.start : node.stop]
            overlap += int(np.count_nonzero(mask[part]))
            left = len(own) - int(np.searchsorted(own, part[-1], "right")) if len(part) else len(own)
            most = overlap + min(node.longest - node.stop, left)
            if (100 + percent) * most < percent * (int(n[x]) + node.least):
                continue
            ending = node.lo
            while ending < node.hi and len(sets[ending]) == node.stop:
                if todo[ending] and groups[ending] != groups[x] and (100 + percent) * overlap >= percent * int(n[x] + n[ending]):
                    out.append((order[x], order[ending]))
                    groups[groups == groups[ending]] = groups[x]
                    todo &= groups != groups[x]
                    before = np.append(0, np.cumsum(todo))
                ending += 1
            stack += [(child, overlap) for child in reversed(node.children)]
        mask[own] = False
    return out


def joined(percent: int):
    """For the homes of one part: links between sets that meet in a home."""

    def run(table: pa.Table) -> pa.Table:
        home = np.asarray(table.column("home"))
        uids, sizes, groups = (np.asarray(table.column(c)) for c in ("uid", "n", "grp"))
        raw = [np.frombuffer(x, np.uint64) for x in _column(table, "tokens")]
        order, found = np.lexsort((uids, home)), []
        cuts = _runs(home[order])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = order[x:y]
            own = own[np.append(True, uids[own][1:] != uids[own][:-1])]
            if len(own) < 2 or (groups[own] == groups[own[0]]).all():
                continue
            number = np.unique(np.concatenate([raw[i] for i in own]), return_inverse=True)[1]
            sets = np.split(number, np.cumsum([len(raw[i]) for i in own])[:-1])
            found += [(uids[own[i]], uids[own[j]]) for i, j in links(sets, sizes[own], groups[own].copy(), percent)]
        common.released()
        return pa.table([pa.array(np.array([p[k] for p in found], np.int64)) for k in (0, 1)], ["a", "b"])

    return run


def linked(placed: DataFrame, reps: DataFrame, groups: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (a, b) between classes of one home. placed: uid, home."""
    full = placed.join(reps.select("uid", "n", "tokens").hint("merge"), "uid").join(groups.hint("merge"), "uid", "left").withColumn("grp", F.coalesce("grp", "uid"))
    full = full.withColumn("part", F.pmod(F.xxhash64("home"), F.lit(parts)))
    return common.written(full.groupBy("part").applyInArrow(joined(percent), "a long, b long"), "links")


def homes(heads: DataFrame, reps: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """uid, home, for every class one; and the pivots in all blocks of their token, too."""
    often = heads.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("k"))
    chosen = heads.join(often.hint("merge"), F.col("token") == F.col("t")).groupBy("uid").agg(F.max(F.struct("k", "token")).alias("top")).select("uid", F.col("top.token").alias("token"))
    # homes of many classes: by ranges of length within which sets may link, then by hash
    long_ = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("long")
    chosen = common.written(chosen.join(reps.select("uid", "n").hint("merge"), "uid").select("uid", "token", "n", long_.alias("range")), "chosen")
    in_range = chosen.groupBy(F.col("token").alias("t"), F.col("range").alias("r")).agg(F.count("*").alias("there"), F.sum("n").alias("tokens"))
    every = Window.partitionBy("t")
    sizes = in_range.withColumn("all", F.sum("there").over(every)).withColumn("all_tokens", F.sum("tokens").over(every))
    at = chosen.join(sizes.hint("merge"), (F.col("token") == F.col("t")) & (F.col("range") == F.col("r")))
    blocks = F.greatest(F.ceil(F.col("there") / F.lit(max(1, block // 2))), F.ceil(2 * F.col("tokens") / F.lit(HOME_TOKENS)))
    single = (F.col("all") <= block) & (F.col("all_tokens") <= HOME_TOKENS)
    name = lambda k: F.when(single, F.xxhash64("token")).otherwise(F.xxhash64("token", "range", k))
    at = at.withColumn("blocks", blocks).withColumn("home", name(F.pmod(F.xxhash64("uid"), F.col("blocks"))))
    pivots = at.filter(~single & (F.pmod(F.xxhash64("uid", F.lit(1)), F.col("there")) < PIVOTS)).select("uid", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), name)).alias("home"))
    own = common.written(at.select("uid", "home", "range"), "homes")
    return own, own.select("uid", "home").unionByName(pivots)


def visits(heads: DataFrame, own: DataFrame, reps: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """uid, home: each class in the homes of those that it shares a token with and whose group is larger (of equals, has the greater id); with those who live there."""
    in_group = common.written(own.join(groups.hint("merge"), "uid", "left").withColumn("grp", F.coalesce("grp", "uid")), "grouped")
    # written, so that the join with it is one that adaptive execution splits where a group is large
    sizes = common.written(in_group.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("size")), "group-sizes")
    ranked = common.written(in_group.join(sizes.hint("merge"), F.col("grp") == F.col("g")).select("uid", "home", "range", F.struct("size", "grp").alias("rank")), "ranked")
    rows = common.written(heads.join(ranked.hint("merge"), "uid"), "ranked-heads")
    per_token = rows.groupBy(F.col("token").alias("t")).agg(F.min("rank").alias("low"), F.max("rank").alias("top")).filter("low <> top").select("t", "top")
    open_ = rows.join(per_token.hint("merge"), F.col("token") == F.col("t"))
    there = open_.groupBy(F.col("token").alias("u"), F.col("home").alias("at")).agg(F.max("rank").alias("best"), F.min("range").alias("least"), F.max("range").alias("most"))
    guests = open_.filter("rank < top").select("token", "uid", "range", "rank").join(there.hint("merge"), F.col("token") == F.col("u"))
    near = (F.col("range") >= F.col("least") - 1) & (F.col("range") <= F.col("most") + 1)
    guests = common.written(guests.filter((F.col("rank") < F.col("best")) & near).select("uid", F.col("at").alias("home")).distinct(), "visits")
    weighed = guests.join(reps.select("uid", "n").hint("merge"), "uid")
    many = weighed.groupBy(F.col("home").alias("h")).agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(HOME_TOKENS))).alias("shares"))
    coming = guests.join(many.hint("merge"), F.col("home") == F.col("h")).select("uid", F.xxhash64("home", F.pmod(F.xxhash64("uid"), F.col("shares"))).alias("home"))
    share = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1), lambda k: F.xxhash64("home", k)))
    living = own.select("uid", "home").join(many.hint("merge"), F.col("home") == F.col("h")).select("uid", share.alias("home"))
    return coming.unionByName(living)


def same_shingles(links_: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """a, b, fits: the links tested on the shingles of the two texts. texts: uid, text."""
    pairs = links_.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(texts.select(F.col("uid").alias("b"), F.col("text").alias("y")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in common.pieces(batches, "x"):
            out = []
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("b", "x", "y"))):
                if b != last:
                    last, held = b, exact(y, words)
                other = exact(x, words)
                both = len(held & other)
                out.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "fits"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, fits boolean")


def grouped(docs: DataFrame, percent: int, words: int, block: int, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """Rows as of signed(); the classes that have links (n, s1, s2, grp); and whether all links are true."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges = max(1, -(-total // RANGE_BYTES))
    rows = common.written(signed(docs, words, seed), "signed")
    sets = by_range(docs, words, ranges, seed).groupBy("part").applyInArrow(counted, ROW).groupBy("batch").applyInArrow(survivors(percent), SET)
    sets = common.written(sets, "sets")
    one = sets.groupBy(*CLASS).agg(F.min("batch").alias("batch"))
    reps = common.written(sets.join(one.hint("merge"), [*CLASS, "batch"]).withColumn("uid", F.monotonically_increasing_id()), "representatives")
    common.drop_written(sets)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
            top = prefix(batch.column("n").to_numpy(), np.array([len(x) for x in raw], np.int64), percent)
            yield pa.RecordBatch.from_arrays([pa.array(_all([x[:k] for x, k in zip(raw, top)], np.int64)), pa.array(np.repeat(batch.column("uid").to_numpy(), top))], ["token", "uid"])

    all_heads = common.written(reps.select("uid", "n", "tokens").mapInArrow(head, "token long, uid long"), "all-heads")
    twice = all_heads.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("k")).filter("k > 1").select("t")
    heads = common.written(all_heads.join(twice.hint("merge"), F.col("token") == F.col("t")).select("token", "uid"), "heads")
    common.drop_written(all_heads)
    held = heads.select("uid").distinct().join(reps.select("uid", "n").hint("merge"), "uid").agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    parts = max(1, -(-held.k // block), -(-(held.n or 0) // HOME_TOKENS))
    own, placed = homes(heads, reps, block)
    alone = reps.select("uid", F.col("uid").alias("grp")).limit(0)
    first = linked(placed, reps, alone, percent, parts)
    groups = common.written(components(first, "a", "b").select(F.col("v").alias("uid"), F.col("c").alias("grp")), "groups")
    second = linked(visits(heads, own, reps, groups, block), reps, groups, percent, parts)
    found = first.unionByName(second)
    # the text of each linked class's least row
    ends = found.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    wanted = reps.select("uid", *CLASS).join(ends.hint("merge"), "uid")
    least = rows.join(wanted.hint("merge"), CLASS).groupBy("uid").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("row")).select("uid", F.col("row.doc_id").alias("r_id"), F.col("row.t1").alias("r1"), F.col("row.t2").alias("r2"))
    texts = docs.join(least.hint("merge"), (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")) & F.col("doc_id").eqNullSafe(F.col("r_id"))).select("uid", "text").dropDuplicates(["uid"])
    texts = common.written(texts, "linked-texts")
    tested = common.written(same_shingles(found, texts, percent, words), "tested-links")
    common.drop_written(texts)
    true = tested.filter("NOT fits").limit(1).count() == 0
    groups = components(found, "a", "b").select(F.col("v").alias("uid"), F.col("c").alias("grp"))
    classes = common.written(reps.select("uid", *CLASS).join(groups.hint("merge"), "uid").select(*CLASS, "grp"), "linked-classes")
    common.drop_written(reps)
    return rows, classes, true


def members(df: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, t1, t2, n, c1, c2: the last two name the group, of one signature or of linked ones (null without a set)."""
    docs = keyed(df, id_col, text_col)
    for seed in range(SEEDS):
        rows, classes, true = grouped(docs, percent, words, block, seed)
        if true:
            break
    else:
        raise RuntimeError("hashes made false links with every seed")
    names = classes.select(F.col("n").alias("m"), F.col("s1").alias("m1"), F.col("s2").alias("m2"), "grp")
    full = rows.join(names.hint("merge"), (F.col("n") == F.col("m")) & (F.col("s1") == F.col("m1")) & (F.col("s2") == F.col("m2")), "left")
    c1 = F.when(F.col("n") > 0, F.when(F.col("grp").isNull(), F.col("s1")).otherwise(F.lit(0)))
    c2 = F.when(F.col("n") > 0, F.when(F.col("grp").isNull(), F.col("s2")).otherwise(F.col("grp")))
    return common.written(full.select("doc_id", "t1", "t2", "n", c1.cast("long").alias("c1"), c2.alias("c2")), "members")


def join(df: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows = members(df, percent, words, block, id_col, text_col)
    least = rows.filter("n > 0").groupBy(F.col("c1").alias("k1"), F.col("c2").alias("k2")).agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).filter("k > 1")
    named = rows.join(least.hint("merge"), (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")), "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df without those whose group has a smaller id; of equal rows with a set one stays. All columns are passed on."""
    rows = members(df, id_col=id_col, text_col=text_col, **options).filter("n > 0")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2")
    best = rows.groupBy(F.col("c1").alias("k1"), F.col("c2").alias("k2")).agg(F.min(row).alias("best"), F.count("*").alias("k")).filter("k > 1").select("k1", "k2", "best")
    inside = rows.groupBy("doc_id", "t1", "t2", "c1", "c2").agg(F.count("*").alias("times")).join(best.hint("merge"), (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")))
    stays = row.eqNullSafe(F.col("best"))
    gone = common.written(inside.filter(~stays | (F.col("times") > 1)).select(F.col("doc_id").alias("g_id"), F.col("t1").alias("g1"), F.col("t2").alias("g2"), stays.alias("again")), "gone-rows")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = df.select("*", F.col(id_col).cast("long").alias("__id"), *(c.alias(f"__t{k}") for k, c in enumerate(hashed(text), 1)))
    same = F.col("__id").eqNullSafe(F.col("g_id")) & (F.col("__t1") == F.col("g1")) & (F.col("__t2") == F.col("g2"))
    kept = own.join(gone.hint("merge"), same, "left_anti")
    if gone.filter("again").limit(1).count():  # a row that is repeated and stays: one of it
        kept = kept.unionByName(own.join(gone.filter("again").hint("merge"), same, "left_semi").dropDuplicates(["__id", "__t1", "__t2"]))
    return kept.drop("__id", "__t1", "__t2")
