"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each linear model also sees the probabilities of the categories before it. While fitting, these are
out-of-fold predictions, so that a later model does not learn to trust what an earlier one has memorised. The inputs are which words and
which five-letter beginnings of words a text holds; the `features` most telling ones are kept, by chi-square with any category.

Models are fitted on a bounded sample: `sample_rows` labelled rows with and as many without the last category, chosen by a hash of the id. Documents are rejected where the last category's
probability reaches the threshold, the least at which out-of-fold precision is `precision` (at least LEAST).

The labels table has one toxicity mark; the chain of the registered query is low quality first, then toxic.

Edge cases: null and empty texts, and others without any feature, get the categories' shares and are not rejected; rows with a null
label are not learnt from; without rows of both kinds a category's probability is its share (0 without labels) and nothing is
rejected; every input row gives one output row; texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

WORDS = re.compile(r"[^\W\d_]+")
BEGINNING = 5
LEAST = 0.2


def held(text: str) -> set[str]:
    """The features of a text: its words, and `beginning*` of the longer ones."""
    words = set(WORDS.findall(text.lower()))
    return words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    features: dict[str, int]
    weights: np.ndarray  # a row for each category: constant, features, logits of the categories before
    threshold: float
    shares: tuple[float, ...]  # of labelled rows in each category

    def rows(self, texts: pa.Array) -> list[list[int]]:
        """The numbers of each text's features."""
        get = self.features.get
        return [sorted(i for i in map(get, held(t)) if i is not None) for t in texts.to_pylist()]

    def predict(self, rows: list[list[int]]) -> np.ndarray:
        """A row of probabilities for each row of feature numbers. All rows' weights are gathered and added up at once, run by run."""
        out, n = np.zeros((len(rows), len(self.names))), len(self.features)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        full = np.flatnonzero(sizes)
        held_ = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(len(self.names)):
            own = self.weights[k].astype(np.float64)
            base = np.full(len(rows), own[0])
            if len(full):
                base[full] += np.add.reduceat(own[1 + held_], starts)
            out[:, k] = _sigmoid(base + _logit(out[:, :k]) @ own[1 + n : 1 + n + k])
        out[sizes == 0] = self.shares
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 200) -> np.ndarray:
    """Weighted logistic regression by accelerated gradient steps; the first column is the constant. Columns are brought to one scale, so that rare features are learnt as fast as common ones."""
    scale = 1 / np.sqrt((weight[:, None] * x * x).mean(0) + 1e-4)
    x = x * scale
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # power iteration: the curvature bounds the step
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(v @ (x.T @ (weight * (x @ v)))) * 1.05 + ridge)
    penalty = np.full(x.shape[1], ridge, x.dtype)
    penalty[0] = 1e-3
    w = last = np.zeros(x.shape[1], x.dtype)
    for t in range(steps):
        ahead = w + (t / (t + 3)) * (w - last)
        w, last = ahead - rate * (x.T @ (weight * (_sigmoid(x @ ahead) - y)) + penalty * ahead), w
    return w * scale


def fit(names: tuple[str, ...], features: list[str], rows: list[list[int]], marks: np.ndarray, rates: np.ndarray, precision: float, folds: int = 3) -> Chain:
    """marks: a column of 0 and 1 for each category. rates: how many labelled rows each row stands for."""
    n, x = len(features), np.zeros((len(rows), 1 + len(features) + len(names)), np.float32)
    x[:, 0] = 1
    for i, r in enumerate(rows):
        x[i, [1 + k for k in r]] = 1
    part, weight, out = np.arange(len(rows)) % folds, (rates / rates.mean()).astype(np.float32), []
    for k in range(len(names)):
        y, used = marks[:, k].astype(np.float32), 1 + n + k
        own = np.zeros(x.shape[1], np.float32)
        unseen = np.zeros(len(rows), np.float32)
        for f in range(folds):
            fitted = linear(x[part != f, :used], y[part != f], weight[part != f])
            unseen[part == f] = _sigmoid(x[part == f, :used] @ fitted)
        own[:used] = linear(x[:, :used], y, weight)
        x[:, used] = _logit(unseen)
        out.append(own)
    order = np.argsort(-unseen)
    right, all_ = np.cumsum((rates * marks[:, -1])[order]), np.cumsum(rates[order])
    good = np.flatnonzero(right >= precision * all_)
    threshold = max(LEAST, float(unseen[order][good[-1]])) if len(good) else 1.0
    shares = tuple(float(x) for x in (marks * rates[:, None]).sum(0) / rates.sum())
    # a text that holds no feature says nothing and is never rejected
    return Chain(names, {f: i for i, f in enumerate(features)}, np.stack(out), max(threshold, float(np.nextafter(shares[-1], 1))), shares)


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = 4000, features: int = 1500, precision: float = 0.99) -> Chain:
    """docs: doc_id, text. categories: a boolean column of labels for each category, in the chain's order; the last one decides."""
    names = tuple(categories)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values()))).dropna().groupBy("doc_id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))))
    last = f"y{len(names) - 1}"
    counts = {r[0]: r.n for r in own.groupBy(last).agg(F.count("*").alias("n"), *(F.sum(f"y{k}").alias(f"s{k}") for k in range(len(names)))).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return _constant(names, counts, total)
    picked = [own.filter(F.col(last) == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    sample = common.written(common.labelled(docs.select("doc_id", "text"), picked[0].unionByName(picked[1])).coalesce(8), "toxicity-sample")
    marks = [f"y{k}" for k in range(len(names))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(len(marks) + 1)]
        for batch in common.pieces(batches):
            for text, *ys in zip(*(batch.column(c).to_pylist() for c in ("text", *marks))):
                own = held(text)
                seen[0].update(own)
                for k, y in enumerate(ys):
                    if y:
                        seen[k + 1].update(own)
        names_ = list(seen[0])
        for i in range(0, len(names_), 20_000):
            part = names_[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[f] for f in part], pa.int64()) for s in seen)], ["f", "n", *(f"n{k}" for k in range(len(marks)))])

    sums = sample.agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in marks)).first()
    if not sums.n:  # no labelled row is a document
        common.drop_written(sample)
        return _constant(names, counts, total)
    counted = sample.mapInArrow(count, "f string, n long" + "".join(f", n{k} long" for k in range(len(marks)))).groupBy("f").agg(F.sum("n").alias("n"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(marks)))).filter("n >= 4")

    def chi(k: int) -> Column:
        all_, pos = float(sums.n), float(sums[marks[k]])
        both, seen_ = F.col(f"n{k}"), F.col("n")
        return F.coalesce(F.pow(both * all_ - seen_ * pos, 2) * all_ / F.nullif(seen_ * pos * (all_ - seen_) * (all_ - pos), F.lit(0.0)), F.lit(0.0))

    share = max(1, features // len(names))
    chosen: dict[str, None] = {}
    for row in [r for k in range(len(marks)) for r in counted.withColumn("c", chi(k)).orderBy(F.desc("c"), "f").limit(share).select("f").collect()]:
        chosen.setdefault(row.f)
    index = {f: i for i, f in enumerate(chosen)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            rows = [sorted(index[f] for f in held(t) if f in index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), *(batch.column(m) for m in marks)], ["doc_id", "x", *marks])

    rows = sorted(sample.mapInArrow(vectors, "doc_id long, x array<int>" + "".join(f", {m} int" for m in marks)).collect(), key=lambda r: (hash_order(r.doc_id), r.x))
    common.drop_written(sample)
    got = Counter(r[last] for r in rows)
    rates = np.array([counts[r[last]] / got[r[last]] for r in rows])
    if len(got) < 2:
        return _constant(names, counts, total)
    return fit(names, list(chosen), [r.x for r in rows], np.array([[r[m] for m in marks] for r in rows]), rates, precision)


def _constant(names: tuple[str, ...], counts: dict, total: int) -> Chain:
    """Without rows of both kinds: every category gets the last one's share, and nothing is rejected."""
    share = counts.get(1, 0) / total if total else 0.0
    return Chain(names, {}, np.zeros((len(names), 1 + len(names))), 2.0, (share,) * len(names))


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 16


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category, rejected."""
    shared = df.sparkSession.sparkContext.broadcast(chain)  # at most `features` weights
    columns = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in common.pieces(batches):
            p = own.predict(own.rows(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(columns))), pa.array(p[:, -1] >= own.threshold)], ["doc_id", *columns, "rejected"])

    return common.documents(df, id_col, text_col).mapInArrow(run, "doc_id long" + "".join(f", {c} double" for c in columns) + ", rejected boolean")


def default_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    return learn(common.documents(docs), labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, default_chain(docs, common.table(spark, sf_dir, "labels"))).select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))


def accepted(df: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """The rows of df that are not rejected, with all their columns. Only the text goes to Python, and only a mark comes back."""
    common.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def marks(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            p = [own.predict(own.rows(piece.column("text"))) for piece in common.pieces(iter([batch]))]
            yield pa.array(np.concatenate(p)[:, -1] < own.threshold if p else [], pa.bool_())

    return df.filter(F.arrow_udf(marks, "boolean")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
