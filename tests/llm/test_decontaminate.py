import random
import re

import pytest

from tallyspark.llm import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            for k in range(max(1, len(b) - 12) if b else 0):
                win = b[k : k + 13]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("most,tokens", [(100_000, 0), (0, 500_000), (0, 0)])
def test_against_brute_force(spark, most, tokens):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choices(["é", "Éa", "b1", "c", "Kel", "x-y", "_", "zu", "the", "İs"], k=n))
    items = [(1, say(30)), (2, say(13)), (3, "Zu the"), (4, None), (5, "..."), (10, say(40)), (10, say(15))]
    docs = [(0, None), (1, ""), (2, "..."), (3, "zu THE"), (4, "zu, the")]
    for i in range(5, 60):
        item = rng.choice([t for _, t in items if t])
        w = item.split(" ")
        cut = " ".join(w[rng.randrange(4) : rng.randrange(5, 50)])
        docs.append((i, f"{say(rng.randrange(60))}. {cut.upper() if rng.random() < 0.2 else cut}! {say(rng.randrange(30))}"))
    d = spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in decontaminate.decontaminate(d, b, broadcast_windows=most, broadcast_tokens=tokens).collect())
    assert got == brute(docs, items)


def test_empty(spark):
    d = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.decontaminate(d, b).first()
    assert (r.doc_id, r.n_words, r.n_hit, r.contaminated) == (None, 2, 0, False)
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_rows_that_share_an_id(spark):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, item + " x"), (1, "y z " + item), (None, item), (None, "clean text only"), (None, "clean text only")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([("i", item)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(d, b).collect())
    assert got == [(0, 3, 0, False), (0, 3, 0, False), (0, 13, 13, True), (1, 14, 13, True), (1, 15, 13, True)]
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and [r.text for r in kept.collect()] == ["clean text only"] * 2
