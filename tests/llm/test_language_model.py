import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import common, language_model
from tallyspark.llm.recurrent import Network, Vocabulary, lanes, score


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def test_base_scores_and_gain(spark):
    rng = random.Random(4)
    kinds = [[f"{p}{i}" for i in range(60)] for p in ("a", "b", "É")]
    rows = [(i, " ".join(rng.choices(kinds[i % 3], k=rng.randrange(5, 80)))) for i in range(300)] + [(500, None), (501, ""), (502, "New One x\x0by"), (None, "a1 a2"), (7, rows_seven := "A1 b2")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, batch string").repartition(3)
    got = language_model.score_documents(df, common.fold(F.col("doc_id"), 5) != 1).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    c = Counter(w for i, t in rows if fold(i) != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if fold(r.doc_id) == 1]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got) and rows_seven


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_documents(df, F.lit(False)).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].score == got[1].base_score == 3 * 0 + got[1].base_score
    assert language_model.score_documents(df.limit(0), F.lit(True)).count() == 0


def vocabulary():
    return Vocabulary(2, np.array([0, 1, 4, 6]))


def test_gradients_and_carried_state():
    rng, kinds = np.random.default_rng(0), vocabulary().class_of()
    assert kinds.tolist() == [0, 1, 2, 3, 3, 3, 4, 4]
    net = Network.new(np.arange(1, 9), vocabulary(), 4)
    for array in (net.out, net.member):
        array[:] = rng.standard_normal(array.shape) * 0.5
    x, y, live, state = rng.integers(0, 8, (7, 3)).astype(np.uint16), rng.integers(0, 8, (7, 3)).astype(np.uint16), np.ones((7, 3), np.float32), rng.standard_normal((3, 4)).astype(np.float32)

    def loss():
        """Plainly: each token's share of its class's share."""
        joint = net.joint(net.forward(x, state, net.embed @ net.given, False)[0]).astype(np.float64)
        out = 0.0
        for row, token in zip(joint, y.ravel()):
            k = int(kinds[token])
            logits = row @ net.out
            out -= logits[k] - np.log(np.exp(logits).sum())
            if k >= 2:
                a, b = vocabulary().edges[k - 2 : k]
                logits = net.member[a:b] @ row
                out -= logits[token - 2 - a] - np.log(np.exp(logits).sum())
        return out / y.size

    grads, _ = net.train(x, y, live, state, kinds)
    for array, grad in zip(net.arrays(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in array.shape)
            kept = array[at]
            array[at] = kept + 1e-2
            up = loss()
            array[at] = kept - 1e-2
            down = loss()
            array[at] = kept
            assert abs((up - down) / 2e-2 - grad[at]) < 3e-4
    texts = [rng.integers(0, 8, k).astype(np.uint16) for k in (1, 40, 100, 33)]
    one = [score(net, [t], 0)[0] for t in texts]
    assert np.allclose(score(net, texts, 0), one, atol=1e-3) and len(lanes(texts, 0)) == 1
    net.out *= 300  # logits of any size
    assert np.isfinite(score(net, texts, 0)).all() and all(np.isfinite(g).all() for g in net.train(x, y, live, state, kinds)[0])


def plain_score(net, tokens):
    """The log probability of one text, a step at a time."""
    kinds, h, state, last, out = net.vocabulary.class_of(), net.hidden.shape[0], np.zeros(net.hidden.shape[0]), 0, 0.0
    for token in tokens:
        given, through = net.embed[last].astype(float) @ net.given, state @ net.hidden
        z, r = (1 / (1 + np.exp(-(given[a : a + h] + through[a : a + h]))) for a in (0, h))
        state = state + z * (np.tanh(given[2 * h :] + r * through[2 * h :]) - state)
        row, k = np.append(state, 1.0), int(kinds[token])
        logits = row @ net.out
        out += logits[k] - np.log(np.exp(logits).sum())
        if k >= net.vocabulary.single:
            a, b = net.vocabulary.edges[k - net.vocabulary.single : k - net.vocabulary.single + 2]
            logits = net.member[a:b] @ row
            out += logits[token - net.vocabulary.single - a] - np.log(np.exp(logits).sum())
        last = token
    return out


def test_scores_against_plain_version(spark, monkeypatch):
    """score is the fitted network's probability of the tokens, and rare words' shares; all words' probabilities add up to one."""
    rng, kept = random.Random(6), {}
    rows = [(i, " ".join(f"w{int(rng.random() ** 3 * 200)}" for _ in range(rng.randrange(3, 60)))) for i in range(200)] + [(300, "w1 neverseen w2"), (301, "w1 " * 500)]
    whole = language_model.trained
    monkeypatch.setattr(language_model, "trained", lambda docs, *a: kept.update(rows=docs, net=whole(docs, *a)) or kept["net"])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learnt = F.col("doc_id") < 150
    got = {r.doc_id: r.score for r in language_model.score_documents(df, learnt, most_words=80).collect()}
    net, text = kept["net"], {r.doc_id: r for r in kept["rows"].collect()}
    c = Counter(w for i, t in rows if i < 150 for w in words(t)[:-1])
    n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    unseen = (n1 + 0.5) / (n1 + 2 * n2 + 1)
    for i, t in rows:
        tokens = np.frombuffer(text[i].tokens, "<u2")
        assert len(tokens) == len(t.split()) + 1 and tokens[-1] == 0
        share = 0.0
        for w, token in zip(t.split(), tokens.tolist()):
            if token < net.vocabulary.single:  # a rare word: its count among those of the same power of two that are rare, too
                if not c[w]:
                    share += math.log10(unseen)
                elif c[w] == 1:
                    share += math.log10((1 - unseen) / n1)
                else:
                    share += math.log10(c[w] / rare_total(c, token, text, rows))
        assert abs(got[i] - plain_score(net, tokens.tolist()) / math.log(10) - share) < 1e-3 * len(tokens)


def rare_total(c, token, text, rows):
    """The training tokens of one class of rare words."""
    own = {w for i, t in rows for w, k in zip(t.split(), np.frombuffer(text[i].tokens, "<u2").tolist()) if k == token}
    return sum(c[w] for w in own)


def test_all_training_documents_are_learnt_from(spark):
    """A long text counts like any other, and the network's words come from all texts."""
    rng = random.Random(2)
    say = lambda p, n: " ".join(f"{p}{rng.randrange(30)}" for _ in range(n))
    rows = [(i, say("ab"[i % 2], 30)) for i in range(60)] + [(100, say("long", 20_000)), (200, say("long", 50)), (201, say("other", 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in language_model.score_documents(df, F.col("doc_id") < 150).collect()}
    assert got[200].n_known == 51 and got[201].n_known == 1
    assert got[200].score > got[201].score


def test_longer_windows_for_the_last_long_texts_change_no_score(monkeypatch):
    from tallyspark.llm import recurrent

    rng = np.random.default_rng(3)
    net = Network.new(np.arange(1, 9), vocabulary(), 4)
    texts = [np.append(rng.integers(0, 8, n), 0).astype(np.uint16) for n in (0, 3, 40, 700, 2100)]
    sizes = np.array([len(t) for t in texts])
    whole = list(recurrent.windows(sizes, texts, 0, recurrent.CELLS))
    assert len(whole) < 5 < -(-2101 // recurrent.WINDOW) and sum(int(w[3].sum()) for w in whole) == sizes.sum()
    long = score(net, texts, 0)
    monkeypatch.setattr(recurrent, "CELLS", 0)
    assert np.allclose(long, score(net, texts, 0), rtol=1e-5)
