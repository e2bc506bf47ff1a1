import random

from pyspark.sql import functions as F

from tallyspark.llm import common, quality, toxicity


def corpus(spark, n=400):
    rng = random.Random(2)
    known = [["".join(rng.choices(letters, k=rng.randrange(4, 9))) for _ in range(150)] for letters in ("abcdefgh", "ijklmnop")]
    say = lambda k, bad=False: " ".join(rng.choices(known[bad], k=k))
    docs, labels = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 6 == 0
        text = say(60, bad)
        if rude:
            text = "moronic fools " + text
        docs.append((i, text))
        if i % 5:
            labels.append((i, int(not bad), int(rude)))
    docs += [(1000, None), (1001, ""), (None, "x"), (1, docs[1][1])]
    return spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels + [(2, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = corpus(spark)
    learnt = common.fold(F.col("doc_id"), 3) != 1
    model = quality.learn(common.documents(docs).filter(learnt), labels.filter(learnt), "quality")
    got = quality.classify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 > 0) for r in held) > 0.95 * len(held)
    none = quality.learn(common.documents(docs), labels.limit(0), "quality")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    docs, labels = corpus(spark)
    chain = toxicity.default_chain(docs, labels)
    got = toxicity.score(docs, chain).collect()
    assert len(got) == docs.count()
    known = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(r.rejected == (r.doc_id % 6 == 0) for r in known) > 0.97 * len(known)
    assert not any(r.rejected for r in got if r.doc_id in (1000, 1001))
    kept = toxicity.accepted(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    nobody = toxicity.default_chain(docs, labels.limit(0))
    assert not any(r.rejected for r in toxicity.score(docs, nobody).collect())


def test_bpe_rows(spark):
    from tallyspark.llm import bpe

    df = spark.createDataFrame([(1, None, b"z"), (None, "héllo wörld's", b"z"), (1, "", b"z")], "doc_id long, text string, ids binary")
    made = bpe.encode(df, bpe.default_vocabulary(), decoded=True)
    got = sorted((r.doc_id or 0, r.n_tokens > 0, bytes(r.decoded).decode()) for r in made.collect())
    assert got == [(0, True, "héllo wörld's"), (1, False, ""), (1, False, "")]
    back = bpe.decode(made, bpe.default_vocabulary()).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == ["", "", "héllo wörld's"]
    assert all((r.ends[-1] if r.ends else 0) == len(r.decoded) for r in back)
    assert bpe.encode(df.limit(0), bpe.default_vocabulary()).count() == 0
