import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyspark.llm import tries


def brute(rows, key):
    """rows: conv_id, turn, role, text. key: the order of equal turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), key(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = {p for p in below if len(p) == len(path) + 1}
        leaves = [p for p in below if not any(q != p and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in ids if rebuilt[c] == path)))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else -99, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def digest_order(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def got(df, **options):
    return sorted(tuple(-99 if v is None else v for v in r) for r in tries.trie(df, **options).select(*tries.COLUMNS).collect())


SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"


@pytest.mark.parametrize("seed,held", [(1, 20_000), (2, 3), (3, 1)])
def test_against_brute_force(spark, seed, held):
    rng = random.Random(seed)
    say = lambda: rng.choice(["hi", "é", "", None, "yes", "no", "a long answer"])
    first = [rng.choice(["user", None, "system"]), say()]
    rows = []
    for c in rng.sample(range(-12, 90), 70):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randrange(1, 12)):
            role, text = first if t == 0 and rng.random() < 0.7 else (rng.choice(["user", "assistant"]), say())
            rows.append((c, rng.choice([t, t, t, None, t - 1]), role, text))
    rows += rows[:5] + [(None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    assert got(df, held=held) == brute(rows, digest_order)


def test_copies_turnless_and_absent_bases(spark):
    turnless = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3)
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1060, 5) for t in range(12)] + [(turnless, 0, "user", "gone")]
    rows += [(c, t, "user", "x" * t) for c in (2001, 2002, 2003) for t in range(4)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    known = got(df)
    assert known == brute(rows, digest_order)
    assert any(r[0] == turnless and r[1] == 0 for r in known)


def test_long_and_empty(spark):
    rows = [(c, t, "user", "w" * (t % 3)) for c in (0, 5) for t in range(3000)]
    out = {(r[0], r[1]): r for r in got(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA), held=500)}
    assert len(out) == 3001 and out[0, 0][3:7] == (2, 1, 1, 3000) and out[0, 3000][4] == 0
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_many_ends(spark):
    df = spark.range(0, 60_000, 5).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "'t' AS text")
    leaf = next(r for r in got(df) if r[1] == 1)
    assert leaf[3] == 12_000 and leaf[7] == hashlib.sha256(",".join(map(str, range(0, 60_000, 5))).encode()).hexdigest()
