"""Language-model scoring: a gated recurrent network with a class-factored output, over whole documents.

Words are runs of bytes other than space and 09-0D with A-Z in lower case, then one end token. The probability of a token is that of its class,
given everything before it in the document, times its probability within the class, given the same.

1. Texts are split into words once, in batches; a batch keeps its documents as word numbers and sends its distinct words (128-bit hashes) with their training counts by hash range.
   The ranges add up the counts of all training documents.
2. The network's vocabulary: the commonest words, as many as the square root of the training tokens, up to `most_words`. They are cut into classes of equal sums of square roots of counts;
   network and softmaxes learn each word's vectors. Rarer words fall into one class for each power of two of their count: the class is predicted from context, and the
   words share it by count. The class of words counted once also holds all unseen words as a single outcome (their share follows Good and Turing: n1 to 2 n2).
3. Each batch gets the counts and numbers of its own words back and stores its documents as sequences of the network's tokens.
4. The network is trained by truncated backpropagation: one pass over a first part of the training documents, then all training documents, in groups, make one pass from there (those of
   the first part are passed twice), and the weights are averaged by tokens.
5. Scoring carries the state through all windows of a document.

base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))): c the token's count, N all, V the distinct training tokens.

Edge cases: null and empty texts are one end token; without training documents N = V = 0 and the score equals the base score; every input row gives one
output row, repeated ids and rows too; null ids are ids like any other; texts of any length are scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.recurrent import Network, Vocabulary, fit, score
from tallyspark.llm.shingles import Words, numbered

MOST_WORDS = 16_384
STATE = 16
END, RARE = 0, 1  # tokens that are classes of their own: the end, words counted once, and from 2 on rare words counted 2^k times and more
BATCH_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
GROUP_TOKENS, FIRST_TOKENS = 6_000_000, 1_500_000
SCORED_BYTES = 8 << 20  # of texts that are scored side by side
CHUNK = 16_384  # weights of a group in a row
WORDS_ROW = "kind int, batch long, part long, first long, digests binary, counts binary, ids binary, nameless binary, learnt binary, sizes binary, places binary, wide boolean"


def split(docs: DataFrame, ranges: int) -> DataFrame:
    """WORDS_ROW. kind 0, a batch: its documents' ids, whether learnt from, sizes in words, and words by place. kind 1, a batch and range: places from `first` on, the words' hashes, their training counts."""
    kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 7, pa.bool_()]
    names = [f.split()[0] for f in WORDS_ROW.split(", ")]

    def packed(held: list[tuple], words: Words, batch: int) -> Iterator[pa.RecordBatch]:
        ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        doc_ids, learnt = pa.chunked_array([h[2] for h in held]), np.concatenate([h[3] for h in held])
        table = words.hashes()
        order = np.lexsort((table[:, 1], table[:, 0]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        at, hashes = place[ids], table[order]
        counts = np.bincount(at[np.repeat(learnt, sizes)], minlength=len(order)).astype("<i8")
        wide = len(order) > 65_536
        about = (doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(), doc_ids.is_null().to_numpy().astype("u1").tobytes(), learnt.astype("u1").tobytes(), sizes.astype("<i8").tobytes(), at.astype("<u4" if wide else "<u2").tobytes())
        out = [(0, batch, None, None, None, None, *about, wide)]
        part = ((hashes[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist() if len(part) else []
        for x, y in zip(edges, edges[1:]):
            out.append((1, batch, int(part[x]), x, hashes[x:y].tobytes(), counts[x:y].tobytes(), *[None] * 5, None))
        for a in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 1024]), kinds)], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, size, number = [], Words(0), 0, TaskContext.get().partitionId() << 32
        for part in common.pieces(parts, most=1 << 20):
            data, offsets = common.utf8(part.column("text"))
            held.append((*numbered(data, offsets, words), part.column("doc_id"), np.asarray(part.column("learnt"))))
            size += len(data) + 64 * part.num_rows
            if size >= BATCH_BYTES:
                yield from packed(held, words, number)
                held, words, size, number = [], Words(0), 0, number + 1
        if held:
            yield from packed(held, words, number)
        del held, words
        common.released()

    return docs.mapInArrow(run, WORDS_ROW)


TOTALS = "part long, n long, v long, n1 long, n2 long, bins binary, digests binary, totals binary, batches binary, firsts binary, sizes binary, inverse binary"


def totals(table: pa.Table) -> pa.Table:
    """One hash range's words with their counts over all batches, sums, how many words there are by power of two of their count, and where in the batches the words are."""
    digests = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column("digests").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist()])
    joined = np.concatenate(digests)
    order = np.lexsort((joined[:, 1], joined[:, 0]))
    ordered = joined[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]).any(1))
    inverse = np.empty(len(order), "<i4")
    inverse[order] = np.cumsum(new) - 1
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    seen = sums > 0
    bins = np.bincount(np.frexp(sums[seen].astype(float))[1], minlength=64).astype("<i8")
    row = [table.column("part")[0].as_py(), int(sums.sum()), int(seen.sum()), int((sums == 1).sum()), int((sums == 2).sum()), bins.tobytes(), ordered[new].tobytes(), sums.astype("<i8").tobytes()]
    row += [np.asarray(table.column("batch"), "<i8").tobytes(), np.asarray(table.column("first"), "<i8").tobytes(), np.array([len(d) for d in digests], "<i8").tobytes(), inverse.tobytes()]
    kinds = [*[pa.int64()] * 5, *[pa.binary()] * 7]
    common.released()
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], [f.split()[0] for f in TOTALS.split(", ")])


def _binned(counts: np.ndarray, single: int) -> np.ndarray:
    """The token of a rare word by its count: 1 for 1, then by powers of two. single: how many tokens are classes of their own."""
    return np.where(counts > 1, np.minimum(np.frexp(counts.astype(float))[1], single - 1), RARE)


def learnt_words(known: DataFrame, sums: dict, most_words: int) -> dict:
    """The network's vocabulary: hashes of its words in order (hi, lo) with their tokens, the classes' edges, and the counts of all tokens."""
    if most_words > 65_536 - 64:
        raise ValueError("tokens are kept in 16 bits, 64 of them at most for rare words: most_words may be 65,472")
    wanted = int(min(most_words, max(64, sums["n"] ** 0.5)))
    bins, level = sums["bins"], 63
    while level > 2 and bins[level:].sum() < wanted:  # words counted twice at least
        level -= 1
    least = 1 << max(level - 1, 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for digests, counts in zip(part.column("digests").to_pylist(), part.column("totals").to_pylist()):
                counts = np.frombuffer(counts, "<i8")
                keep = counts >= least
                own = np.frombuffer(digests, np.int64).reshape(-1, 2)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(counts[keep].astype(np.int64))], ["hi", "lo", "c"])

    rows = known.select("digests", "totals").mapInArrow(run, "hi long, lo long, c long").orderBy(F.desc("c"), "hi", "lo").limit(wanted).toArrow()
    hashes = np.stack([np.asarray(rows.column(c)) for c in ("hi", "lo")], 1).view(np.uint64)
    counts = np.asarray(rows.column("c")).astype(float)
    mass = np.cumsum(np.sqrt(counts))
    many = max(1, round(len(counts) ** 0.5))
    edges = np.unique(np.append(np.searchsorted(mass, mass[-1] * np.arange(many) / many), len(counts))) if len(counts) else np.zeros(1, np.int64)
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    # without any word counted twice, or with all of these, rare words are those counted once; else the least count of the network's words bounds them
    single = int(np.frexp(counts.min())[1]) + 1 if len(counts) else 2
    return {"hashes": hashes[order], "tokens": (single + order).astype(np.uint16), "counts": counts, "vocabulary": Vocabulary(single, edges)}


def replies(known: DataFrame, words: dict) -> DataFrame:
    """batch, first, counts, tokens: what a batch asked a range about."""
    held = known.sparkSession.sparkContext.broadcast({k: words[k] for k in ("hashes", "tokens")})  # MOST_WORDS entries at most
    single = words["vocabulary"].single

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tokens = held.value["hashes"], held.value["tokens"]
        for part in parts:
            for digests, sums, batches, firsts, sizes, inverse in zip(*(part.column(c).to_pylist() for c in ("digests", "totals", "batches", "firsts", "sizes", "inverse"))):
                own, sums = np.frombuffer(digests, np.uint64).reshape(-1, 2), np.frombuffer(sums, "<i8")
                token = _binned(sums, single).astype("<u2")
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes[:, 0], own[:, 0]), len(hashes) - 1)
                    found = (hashes[at] == own).all(1)
                    # two of the network's words may begin with the same 64 bits
                    after = np.minimum(at + 1, len(hashes) - 1)
                    second = ~found & (hashes[after] == own).all(1)
                    token[found], token[second] = tokens[at[found]], tokens[after[second]]
                inverse = np.frombuffer(inverse, "<i4")
                cuts = np.append(0, np.cumsum(np.frombuffer(sizes, "<i8"))).tolist()
                rows = [(b, f, sums[inverse[x:y]].tobytes(), token[inverse[x:y]].tobytes()) for b, f, x, y in zip(np.frombuffer(batches, "<i8").tolist(), np.frombuffer(firsts, "<i8").tolist(), cuts, cuts[1:])]
                for a in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 1024]), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["batch", "first", "counts", "tokens"])
        common.released()

    return known.drop("part", "n", "v", "n1", "n2", "bins").mapInArrow(run, "batch long, first long, counts binary, tokens binary")


def encoded(batches: DataFrame, answers: DataFrame, sums: dict, shares: np.ndarray) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, base_score, share (sum of log10 of rare words' shares of their classes), tokens. shares: log10 of a word's share of its class, but for its count, by token."""
    per, ends = sums["n"] + 0.5 * (sums["v"] + 1), sums["ends"]
    end_base, unseen = float(np.log10((ends + 0.5) / per)), sums["unseen"]
    names, kinds = ["doc_id", "learnt", "n_tokens", "n_known", "base_score", "share", "tokens"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]

    single = len(shares)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.compute.sort_indices(right, [("first", "ascending")]))
        c = np.frombuffer(b"".join(right.column("counts").to_pylist()), "<i8").astype(float)
        token = np.frombuffer(b"".join(right.column("tokens").to_pylist()), "<u2")
        base = np.log10((c + 0.5) / per)
        share = np.where(token < single, shares[np.minimum(token, single - 1)] + np.where(token > RARE, np.log10(np.maximum(c, 1)), 0), 0.0)
        share[c == 0] = unseen
        row = {k: left.column(k)[0].as_py() for k in left.column_names}
        sizes, at = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["places"], "<u4" if row["wide"] else "<u2")
        n = len(sizes)
        starts, full = np.cumsum(sizes) - sizes, np.flatnonzero(sizes)

        def summed(x: np.ndarray) -> np.ndarray:
            out = np.zeros(n)
            if len(full):
                out[full] = np.add.reduceat(x[at], starts[full])
            return out

        every = token[at]
        texts = [every[a:b].tobytes() + b"\0\0" for a, b in zip(starts.tolist(), (starts + sizes).tolist())]
        ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nameless"], "u1") > 0)
        columns = [ids, pa.array(np.frombuffer(row["learnt"], "u1") > 0), pa.array(sizes + 1), pa.array(summed((c > 0).astype(float)).astype(np.int64) + int(ends > 0)), pa.array(summed(base) + end_base), pa.array(summed(share)), pa.array(texts, pa.binary())]
        common.released()
        return pa.table([x.cast(k) for x, k in zip(columns, kinds)], names)

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, "doc_id long, learnt boolean, n_tokens long, n_known long, base_score double, share double, tokens binary")


def trained(docs: DataFrame, words: dict, counts: np.ndarray, n: int, rate: float = 0.02) -> Network:
    """The network after one pass over all training documents. Only weights come to the driver, summed over the groups."""
    network, spark = Network.new(counts, words["vocabulary"], STATE), docs.sparkSession
    learnt = docs.filter("learnt").select("tokens", F.xxhash64("tokens", "doc_id", F.lit(5)).alias("place"))

    def passed(rows: DataFrame, start: Network, pace: float) -> Network:
        held = spark.sparkContext.broadcast(start)

        def run(table: pa.Table) -> pa.Table:
            own = held.value.like(held.value.flat())
            order = pa.compute.sort_indices(table, [("place", "ascending"), ("tokens", "ascending")])
            texts = [np.frombuffer(x, "<u2") for x in table.column("tokens").take(order).to_pylist()]
            weight = float(sum(map(len, texts)))
            flat = fit(own, texts, END, pace).flat().astype(np.float64) * weight
            pieces = [flat[a : a + CHUNK].tobytes() for a in range(0, len(flat), CHUNK)]
            common.released()
            return pa.table([pa.array(np.arange(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()), pa.array([weight] * len(pieces))], ["i", "x", "w"])

        def mean(table: pa.Table) -> pa.Table:
            total, weight = 0.0, float(np.asarray(table.column("w")).sum())
            for x in table.column("x").to_pylist():
                total = total + np.frombuffer(x, np.float64)
            return pa.table([pa.array([table.column("i")[0].as_py()], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["i", "x"])

        means = rows.groupBy("part").applyInArrow(run, "i int, x binary, w double").groupBy("i").applyInArrow(mean, "i int, x binary")
        flat = b"".join(bytes(r.x) for r in sorted(means.collect(), key=lambda r: r.i))
        return start.like(np.frombuffer(flat, np.float32)) if flat else start

    share = lambda size: F.pmod(F.xxhash64("place"), F.lit(max(1, -(-n // size))))
    network = passed(learnt.filter(share(FIRST_TOKENS) == 0).withColumn("part", F.lit(0)), network, rate)
    return passed(learnt.withColumn("part", share(GROUP_TOKENS)), network, rate / 3)


def score_documents(df: DataFrame, learnt: Column, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score. learnt: which rows may be learnt from, by doc_id."""
    spark = df.sparkSession
    docs = common.documents(df, id_col, text_col).withColumn("learnt", F.coalesce(learnt, F.lit(False)))
    about = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count_if("learnt").alias("ends")).first()
    ranges = max(1, -(-(about.n or 0) // RANGE_BYTES))
    stored = common.written(split(docs, ranges), "words")
    known = common.written(stored.filter("kind = 1").select("part", "batch", "first", "digests", "counts").groupBy("part").applyInArrow(totals, TOTALS), "word-totals")
    sums, bins = {"n": 0, "v": 0, "n1": 0, "n2": 0, "ends": about.ends}, np.zeros(64, np.int64)
    by_bin = known.select("n", "v", "n1", "n2", *(F.conv(F.hex(F.reverse(F.substring("bins", 8 * k + 1, 8))), 16, 10).cast("long").alias(f"b{k}") for k in range(64)))
    first = by_bin.agg(*(F.sum(c).alias(c) for c in by_bin.columns)).first()
    if first.n is not None:
        sums |= {k: first[k] for k in ("n", "v", "n1", "n2")}
        bins[:] = [first[f"b{k}"] for k in range(64)]
    sums |= {"n": sums["n"] + about.ends, "v": sums["v"] + (about.ends > 0), "bins": bins}
    words = learnt_words(known, sums, most_words)
    # what is left for the classes of rare words, by token
    by_token = _tokens_of_rare(known, words)
    counts = np.concatenate([by_token, words["counts"]])
    counts[END] = about.ends
    rare, two = sums["n1"], sums["n2"]
    share = (rare + 0.5) / (rare + 2 * two + 1.0)
    sums["unseen"] = float(np.log10(share))
    shares = np.zeros(len(by_token))
    with np.errstate(divide="ignore"):
        shares[RARE] = np.log10((1 - share) / max(1.0, by_token[RARE]))
        shares[RARE + 1 :] = -np.log10(np.maximum(by_token[RARE + 1 :], 1.0))
    out = common.written(encoded(stored.filter("kind = 0").select("batch", "ids", "nameless", "learnt", "sizes", "places", "wide"), replies(known, words), sums, shares), "encoded")
    common.drop_written(stored)
    common.drop_written(known)
    columns = ["doc_id", "n_tokens", "n_known", "base_score"]
    if not sums["n"]:
        return out.select("doc_id", "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"), "base_score", F.col("base_score").alias("score"))
    held = spark.sparkContext.broadcast(trained(out, words, counts, sums["n"]))

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        # the more texts side by side, the fewer steps with only the longest of them
        some, size = [], 0
        for part in common.pieces(parts, "tokens", 2 << 20):
            some.append(part)
            size += part.nbytes
            if size >= SCORED_BYTES:
                yield pa.Table.from_batches(some)
                some, size = [], 0
        if some:
            yield pa.Table.from_batches(some)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(parts):
            gained = score(held.value, [np.frombuffer(x, "<u2") for x in table.column("tokens").to_pylist()], END) / np.log(10)
            yield from table.select(columns).append_column("score", pa.array(gained + table.column("share").to_numpy())).to_batches()
        common.released()

    scored = out.select(*columns, "share", "tokens").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(sums["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def _tokens_of_rare(known: DataFrame, words: dict) -> np.ndarray:
    """How often the classes of rare words occur in training: all words' counts by power of two, without the network's own."""

    single = words["vocabulary"].single

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(single, np.int64)
        for part in parts:
            for x in part.column("totals").to_pylist():
                c = np.frombuffer(x, "<i8")
                out += np.bincount(_binned(c, single), c, single).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(single)), pa.array(out)], ["i", "n"])

    out = np.zeros(single)
    for r in known.select("totals").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    own = words["counts"].astype(np.int64)
    return out - np.bincount(_binned(own, single), own, single) if len(own) else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(common.table(spark, sf_dir, "documents"), common.fold(F.col("doc_id"), 5) != 1)
    return out.withColumn("held_out", common.fold(F.col("doc_id"), 5) == 1)
