import random
import re

import pytest

from tallyspark.llm import jaccard


def shingle_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    sets, top = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sorted((rows[i][0] if rows[i][0] is not None else -1, len(sets[i]), min((rows[k][0] for k in g if rows[k][0] is not None), default=-1)) for g in groups.values() for i in g)


@pytest.mark.parametrize("seed,block", [(0, 4000), (1, 6)])
def test_against_brute_force(spark, seed, block):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Über", "MIX"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  TWO\t"), (5, "one two three"), (None, "one two")]
    for base in range(8):
        words = rng.choices(vocabulary, k=rng.randrange(5, 120))
        for _ in range(rng.randrange(2, 12)):
            copy = list(words)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: int(len(copy) * rng.uniform(0.75, 1))] or copy
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                rows.append((len(rows) * 3 + 1000, " ".join(copy).upper()))
    rows.append(rows[-1])
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, uid string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.join(df, block=block).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def ids(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_few_words_in_a_partition(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string").coalesce(1)
    assert ids(jaccard.join(df)) == {1: (1, 1), 2: (0, 2)}


def test_words_that_polynomial_hashes_confuse(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    tail = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, word), (2, other), (3, word), (4, f"{word} {tail}"), (5, f"{other} {tail}")], "doc_id long, text string")
    assert {i: c for i, (_, c) in ids(jaccard.join(df)).items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_false_links_of_a_seed_are_found(spark, monkeypatch):
    tested = []
    whole = jaccard.same_shingles

    def first_is_false(*args):
        tested.append(1)
        return whole(*args).selectExpr("a", "b", f"fits AND {len(tested) > 1} AS fits")

    monkeypatch.setattr(jaccard, "same_shingles", first_is_false)
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    assert {c for _, c in ids(jaccard.join(df)).values()} == {1} and len(tested) == 2


@pytest.mark.parametrize("block,tokens", [(4, 1 << 30), (40, 1 << 30), (40, 300)])
def test_large_groups_and_common_lines(spark, monkeypatch, block, tokens):
    monkeypatch.setattr(jaccard, "HOME_TOKENS", tokens)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choices([f"v{i}" for i in range(900)], k=n))
    base, line, rows = say(60), say(12), []
    for i in range(70):
        words = base.split()
        words[rng.randrange(60)] = f"x{i}"
        if i % 9 == 0:
            words[rng.randrange(60)] = f"y{i}"
            words[rng.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, base) for i in range(30)] + [(200 + i, f"{line} {say(3 + i % 4)} {line}") for i in range(60)] + [(300 + i, line) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((i, n, c) for i, (n, c) in ids(jaccard.join(df, block=block)).items()) == brute(rows)


def test_representatives(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), "other words here"
    rows = [(None, a), (5, a), (5, a), (7, a + " x"), (None, b), (None, b), (9, ""), (9, ""), (9, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = jaccard.representatives(df)
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert kept.columns == df.columns and got == [(0, b), (5, a), (9, ""), (9, ""), (9, "")]
