import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tallyspark.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs, least=40, enough=5):
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    last = {k: max(ids, key=order) for k, ids in held.items() if len(ids) >= enough}
    out = []
    for i, text in docs:
        split = (text or "").split("\n")
        stay = [x for x in split if key(x) not in last or last[key(x)] == i]
        out.append((order(i), len(split), len(split) - len(stay), "\n".join(stay)))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choices("abcé ßÀİ\u0085xyzABC\r\t", k=k))
    common = [say(rng.choice([38, 39, 40, 41, 60, 90])) for _ in range(25)] + ["x" * 39, "y" * 40, "é" * 40, "é" * 39]
    docs = [(0, None), (1, ""), (2, "\n"), (3, "y" * 40), (4, "Y" * 40 + "\r\n")]
    for i in range(5, n):
        rows = []
        for _ in range(rng.randrange(8)):
            line = rng.choice(common) if rng.random() < 0.6 else say(rng.randrange(70))
            rows += [rng.choice(["", " ", "\t"]) + (line.upper() if rng.random() < 0.1 and line.isascii() else line) + rng.choice(["", "\r", "  "])] * rng.choice([1, 1, 2])
        docs.append((rng.choice([i, i, i, i - 1, None]), "\n".join(rows)))
    return docs + docs[50:55]


@pytest.mark.parametrize("most,options", [(1 << 20, {}), (0, {"shard_bytes": 500, "held": 7})])
def test_against_brute_force(spark, most, options):
    docs = corpus(4)
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, kept int, h string").repartition(5)
    out = lines.dedup(df, broadcast_keys=most, keep=("h",), **options)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept", "h"]
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_lines, r.n_dropped, r.kept) for r in out.collect())
    assert got == brute(docs) and sum(x[2] for x in got) > 100
    assert lines.dedup(df.limit(0), broadcast_keys=most).count() == 0


def test_query_digest(spark, tmp_path):
    text = "\n".join(["a" * 50, "own %d"])
    spark.createDataFrame([(i, text % i) for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in lines.query(spark, f"file://{tmp_path}").collect()}
    assert [(rows[i].n_lines, rows[i].n_dropped) for i in range(6)] == [(2, 1)] * 5 + [(2, 0)]
    assert rows[3].kept_sha256 == hashlib.sha256(b"own 3").hexdigest()


def test_filters_lose_nothing():
    rng = np.random.default_rng(1)
    once, often = rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 1 << 64, 300, np.uint64)
    parts = [(np.unique(np.append(once[k::5], often[k % 2 :: 2])), np.unique(rng.integers(0, 1 << 64, 20, np.uint64))) for k in range(5)]
    found = lines.suspected(parts)
    assert set(often) <= set(found) and all(set(more) <= set(found) for _, more in parts)
    assert len(found) < 300 + 100 + 500  # few hashes only look repeated


def test_long_text(spark):
    rows = [(i, ("z" * 45 + "\n") * 20_000) for i in range(6)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, len(r.kept)) for r in got) == [(i, 20_001, 20_000, 0) for i in range(5)] + [(5, 20_001, 0, 46 * 20_000)]
