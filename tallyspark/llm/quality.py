"""Quality by compression: Zstandard dictionaries of good and of bad text, and how much better each one fits.

A bounded sample of labelled rows (`sample_rows` of each label, in the order of a hash of the id, and no more than have `sample_bytes` of text together, or one) is taken whole and split in two:
one part builds a dictionary for either label, the other calibrates. A text is cut into blocks; each block is compressed with both dictionaries
and the score's inputs are the normalised size difference (good - bad) / (good + bad) over the whole text, the same for its blocks at both ends of the
range, and the compressed share of the text. A logistic curve fitted on the calibration part turns them into a probability.

Edge cases: of documents that share a labelled id one is learnt from; null texts count as empty and score as the sample's base rate of good labels; rows with a null label are not learnt from; with labels of one
kind only, or none, every score is the base rate (0.5 without labels); every input row gives one output row; whole texts are scored, block
by block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

BLOCK = 2048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    base: float
    low: tuple[float, ...] = ()  # the calibration part's range; inputs beyond it count as its ends
    high: tuple[float, ...] = ()


@lru_cache(2)
def _compressors(good: bytes, bad: bytes) -> tuple:
    made = []
    for data in (good, bad):
        own = zstandard.ZstdCompressionDict(data)
        own.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))
    return tuple(made)


def features(data: bytes, good: bytes, bad: bytes) -> list[float]:
    """1, the whole text's normalised difference, its least and greatest over blocks, the compressed share."""
    a, b = _compressors(good, bad)
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 4:
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    sizes = np.array([(len(a.compress(x)), len(b.compress(x))) for x in blocks], float)
    each, whole = (sizes[:, 0] - sizes[:, 1]) / sizes.sum(1), sizes.sum(0)
    return [1.0, (whole[0] - whole[1]) / whole.sum(), each.min(), each.max(), whole.sum() / (2 * len(data))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method on the penalised log-likelihood; the first column is the constant."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.append(0, np.ones(x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


SCALE = np.array([1.0, 20.0, 20.0, 20.0, 4.0])


def _dictionary(texts: list[bytes], size: int) -> bytes:
    blocks = [x[i : i + BLOCK] for x in texts for i in range(0, len(x), BLOCK)]
    blocks = [x for x in blocks if len(x) >= 8]
    if sum(map(len, blocks)) < 8 * size or len(blocks) < 16:
        return b"".join(blocks)[-size:] or b"\0" * 8  # too little to train on: the text itself is the dictionary
    return zstandard.train_dictionary(size, blocks).as_bytes()


def fit(rows: list[tuple[bytes, int]], share: float, dictionary_bytes: int = 65_536) -> Model:
    """rows: texts and labels (1: good), of which every third calibrates. share: of good labels among all labelled rows."""
    if len({y for _, y in rows}) < 2:
        return Model(b"", b"", (), share)
    build, hold = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0 and r[0]]
    if len({y for _, y in hold}) < 2:
        build, hold = rows, [r for r in rows if r[0]]
    good, bad = (_dictionary([x for x, y in build if y == k], dictionary_bytes) for k in (1, 0))
    x, y = np.array([features(t, good, bad) for t, _ in hold]) * SCALE, np.array([y for _, y in hold], float)
    return Model(good, bad, tuple(logistic(x, y)), share, tuple(x.min(0)), tuple(x.max(0)))


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    out = np.full(len(texts), model.base)
    if model.weights:
        full = [i for i, t in enumerate(texts) if t]
        if full:
            x = np.clip(np.array([features(texts[i], model.good, model.bad) for i in full]) * SCALE, model.low, model.high)
            out[full] = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = 1500, sample_bytes: int = 48 << 20) -> Model:
    """docs: doc_id, text; labels: doc_id, and `label` with 1 for good. Both already cut to the rows that may be learnt from."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Model(b"", b"", (), share)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = [own.filter(F.col("y") == k).orderBy(*order).limit(sample_rows) for k in (0, 1)]
    sample = common.labelled(docs.select("doc_id", "text"), picked[0].unionByName(picked[1])).select("doc_id", "y", F.encode("text", "UTF-8").alias("t"), F.xxhash64("doc_id").alias("h"))
    sample = common.written(sample.coalesce(8), "quality-sample")
    # texts come to the driver only as far as their sizes add up to the bound
    taken, held = [], {0: 0, 1: 0}
    for r in sorted(sample.select("doc_id", "y", "h", F.octet_length("t").alias("size")).collect(), key=lambda r: (r.h, r.doc_id)):
        if held[r.y] == 0 or held[r.y] + r.size <= sample_bytes:
            taken.append(r.doc_id)
        held[r.y] += max(r.size, 1)
    chosen = docs.sparkSession.createDataFrame([(i,) for i in taken], "doc_id long")
    rows = sorted(sample.join(F.broadcast(chosen), "doc_id").collect(), key=lambda r: (r.h, r.doc_id))
    common.drop_written(sample)
    return fit([(bytes(r.t), r.y) for r in rows], share)


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of a good label)."""
    held = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            data, offsets = common.utf8(batch.column("text"))
            cuts = offsets.tolist()
            scores = score_texts(held.value, [data[a:b] for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return common.documents(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    learnt = common.fold(F.col("doc_id"), 3) != 1
    model = learn(common.documents(docs).filter(learnt), common.table(spark, sf_dir, "labels").filter(learnt), "quality")
    return classify(docs, model).select("doc_id", (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
