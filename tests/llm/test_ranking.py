import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import ranking


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, most):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, (i is not None, i or 0)))
        out += [(item, rank, i[1] if i[0] else None, -s) for rank, (s, i) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,most,options", [(1, 20, {}), (2, 3, {"shard_bytes": 400, "block_bytes": 200}), (3, 5, {"shard_bytes": 3000, "block_cost": 0})])
def test_against_brute_force(spark, seed, most, options):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a1", "é", "Éa", "zu", "K", "K"] + [f"w{i}" for i in range(40)]
    say = lambda k: "".join(rng.choice(vocabulary[: rng.choice([4, 8, 48])]) + rng.choice([" ", ", ", "_", " ", "\n"]) for _ in range(k))
    docs = [(i if rng.random() < 0.95 else None, say(rng.randrange(1, 60))) for i in range(300)] + [(7, ""), (8, None), (9, "..."), (10, "The the")] + [(400 - i, "w1 w2 w3") for i in range(60)]
    docs += docs[:9]
    items = [(i, say(rng.randrange(1, 20))) for i in range(12)] + [(12, None), (13, "!"), (14, "nowhere"), (15, "w1 w1 w2"), (15, "w1 w1 w2"), (15, "w9"), (None, "w3 w4")]
    d = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, score int, item_id string").repartition(4)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    out = ranking.rank(d, b, most, **options)
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()]
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and dict(out.dtypes)["rank"] == "int"
    assert sorted(got, key=str) == brute(docs, items, most)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    b = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert ranking.rank(d.limit(0), b).count() == 0 and ranking.rank(d, b.limit(0)).count() == 0
    assert [tuple(r) for r in ranking.rank(d, b).collect()] == [("x", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 1200)))]


def plain_cut(docs, impacts, cost, longest):
    best = [0]
    for j in range(1, len(impacts) + 1):
        best.append(min(best[i] + (docs[j - 1] - docs[i] + 1) * max(impacts[i:j]) + cost for i in range(max(0, j - longest), j)))
    return best[-1]


def test_blocks_have_the_least_cost():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 7, 30, 2, 90, 12])
    impacts, starts = rng.integers(0, 100, int(sizes.sum())), np.cumsum(sizes) - sizes
    docs = np.concatenate([np.sort(rng.choice(150, n, False)) for n in sizes])
    marks = ranking.cut(docs, impacts, starts, sizes, 60, 16)
    for a, n in zip(starts, sizes):
        of, own, at = docs[a : a + n].tolist(), impacts[a : a + n].tolist(), np.append(np.flatnonzero(marks[a : a + n]), n)
        assert at[0] == 0 and np.diff(at).max() <= 16
        assert sum((of[j - 1] - of[i] + 1) * max(own[i:j]) + 60 for i, j in zip(at[:-1], at[1:])) == plain_cut(of, own, 60, 16)


def test_blocks_are_skipped():
    rng = np.random.default_rng(6)
    n = 4000
    row = {"sizes": rng.integers(20, 400, n).tobytes(), "terms": [0, 1], "dfs": [n, 300]}
    rare = np.sort(rng.choice(n, 300, False))
    row["docs"] = np.concatenate([np.arange(n), rare]).astype(np.uint32).tobytes()
    row["tfs"] = rng.integers(1, 4, n + 300).astype(np.uint32).tobytes()
    shard, best = ranking.Shard(row, n, 200 * n, 1_000_000), ranking.Best(20)
    scored = ranking.search(shard, np.column_stack([np.ones(n, np.int64), np.arange(n)]), [(0, 5), (1, 2500)], best)
    every = shard.scores([(0, 5), (1, 2500)], np.arange(n))
    assert best.rows[:, 0].tolist() == np.sort(every)[::-1][:20].tolist() and scored < n // 4
    assert (shard.bounds([(0, 5), (1, 2500)]) >= every).all() and len(shard.blocks) < (n + 300) // 3


def test_long_text(spark, monkeypatch):
    text = "Alpha beta-" * 300_000  # longer than a slice
    d = spark.createDataFrame([(1, text), (2, "alpha")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "beta alpha")], "item_id long, text string")
    assert [(r[0], r[1], r[2], r[3]) for r in ranking.rank(d, b).orderBy("rank").collect()] == sorted(brute([(1, text), (2, "alpha")], [(1, "beta alpha")], 20), key=lambda r: r[1])
