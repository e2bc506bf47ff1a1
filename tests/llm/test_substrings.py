import random
from collections import Counter

import pytest

from tallyspark.llm import substrings


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cut = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        runs = "".join(map(str, cut)).split("0")
        out.append((len(d), bytes(x for x, c in zip(d, cut) if not c), sum(bool(r) for r in runs)))
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 6))) for _ in range(n))


@pytest.mark.parametrize("seed,hot,shard", [(0, 4000, 2 << 20), (1, 3, 800), (2, 2, 500)])
def test_against_brute_force(spark, seed, hot, shard):
    rng, length = random.Random(seed), 60
    shared = [words(rng, 25) for _ in range(6)]
    texts = [None, "", "short", "a" * 300, "a" * 300, "ab" * 200, "x" * 59, "x" * 60, "x" * 60]
    for _ in range(50):
        parts = [words(rng, rng.randrange(20))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), words(rng, rng.randrange(12))]
        texts.append(" ".join(parts))
    texts += [texts[20], texts[21] + " tail", "head " + texts[22], shared[0] * 3]
    rows = [(None if i == 30 else i % 55, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.removed)) for r in substrings.dedup(df, length, hot_regions=hot, shard_bytes=shard).collect())
    want = Counter((r[0], *b) for r, b in zip(rows, brute(texts, length)))
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(df).count() == 0


def test_cut():
    import numpy as np
    import pyarrow as pa

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    spans = pa.array([[{"a": 1, "b": 3}, {"a": 2, "b": 5}], None, [{"a": 0, "b": 2}], [], [{"a": 0, "b": 1}, {"a": 3, "b": 4}]], kind)
    kept, runs = substrings.cut(b"abcdeXYab0123", np.array([0, 5, 5, 7, 9, 13]), spans)
    assert kept.to_pylist() == [b"a", b"", b"", b"ab", b"12"]
    assert [[(x["start"], x["end"]) for x in r] for r in runs.to_pylist()] == [[(1, 5)], [], [(0, 2)], [], [(0, 1), (3, 4)]]


def test_a_text_that_repeats_itself_changes_nothing_for_its_batch(spark):
    import random

    rng = random.Random(8)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, own = say(450), say(420)
    rows = [(0, 1, say(900) + shared + say(700)), (0, 2, own + say(300) + own), (1, 3, say(500) + shared + say(800))]
    # the first two texts are one batch, the third is another
    docs = spark.createDataFrame(rows, "part int, doc_id long, text string").repartitionByRange(2, "part").drop("part")
    from tallyspark.llm import substrings as module

    got = {r.doc_id: sum(x.end - x.start for x in r.removed) for r in module.dedup(docs).collect()}
    assert got[1] >= 450 and got[3] == got[1] < 470 and got[2] >= 840


def test_hashes_of_a_batch_stay_exact_beside_a_long_repeat_in_one_text(spark):
    """Only stretches longer than an anchor's whole region (560 bytes) are found within their text; these once made the batch's hashes inexact."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, own = say(450), say(2000)
    texts = [say(900) + shared + say(700), own + say(300) + own, say(500) + shared + say(800)]
    docs = spark.createDataFrame([(i // 2, i, t) for i, t in enumerate(texts)], "part int, doc_id long, text string").repartitionByRange(2, "part").drop("part")
    got = {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.removed)) for r in substrings.dedup(docs).collect()}
    assert got == dict(enumerate(brute(texts, 400)))
