"""op4, op6 and op7 against plain versions: fitted models applied a text at a time, and pages generated with their text."""

import math
import random

import pytest
import zstandard

from pyspark.sql import functions as F

from tallyspark.llm import common, quality, toxicity
from tallyspark.llm.html_text import extract

from .test_classifiers import corpus


def plain_quality(model, text):
    """The fitted model's score of one text, block by block."""
    data = (text or "").encode()
    if not data or not model.weights:
        return model.base
    cuts = list(range(0, len(data), 2048)) + [len(data)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < 512:
        del cuts[-2]
    made = []
    for held in (model.good, model.bad):
        compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(held), level=3, write_content_size=False, write_dict_id=False, write_checksum=False)
        made.append([len(compressor.compress(data[a:b])) for a, b in zip(cuts, cuts[1:])])
    each = [(g - b) / (g + b) for g, b in zip(*made)]
    good, bad = map(sum, made)
    x = [1.0, 20 * (good - bad) / (good + bad), 20 * min(each), 20 * max(each), 4 * (good + bad) / (2 * len(data))]
    x = [min(max(v, a), b) for v, a, b in zip(x, model.low, model.high)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(w * v for w, v in zip(model.weights, x))))))


def test_quality_scores(spark):
    docs, labels = corpus(spark)
    long_ = docs.limit(40).select((F.col("doc_id") + 5000).alias("doc_id"), F.concat(F.repeat(F.concat("text", F.lit(" ")), 25), F.lit("é")).alias("text"), "score")
    docs = docs.unionByName(long_)
    model = quality.learn(common.documents(docs), labels, "quality")
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    got = {}
    for r in quality.classify(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert set(got) == set(texts)
    for i, scores in got.items():
        assert sorted(scores) == pytest.approx(sorted(plain_quality(model, t) for t in texts[i]), abs=1e-9)


def test_quality_learns_from_whole_texts(spark):
    """A long text whose end alone tells its label; the bound is on rows, by their bytes."""
    rng = random.Random(4)
    noise = lambda: "".join(rng.choices("pqrstuvwxyz ", k=30_000))
    docs = [(i, noise() + ("lovely clear prose and reason " if i % 2 else "zzkk qqjj xxvv wwpp ") * 400) for i in range(60)] + [(0, "repeated"), (None, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.learn(common.documents(df), labels, "quality")
    got = {r.doc_id: r.score for r in quality.classify(df.filter("text <> 'repeated'"), model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(60))
    few = quality.learn(common.documents(df), labels, "quality", sample_bytes=1)
    assert few.good != model.good  # one row of each label was taken



def plain_toxicity(chain, text):
    """The chain's probabilities of one text, category after category."""
    words = toxicity.held(text or "")
    known = [i for f, i in chain.features.items() if f in words]
    if not known:
        return list(chain.shares)
    out, n = [], len(chain.features)
    for k in range(len(chain.names)):
        own = [float(x) for x in chain.weights[k]]
        total = own[0] + sum(own[1 + i] for i in known)
        for j, p in enumerate(out):
            p = min(max(p, 1e-3), 1 - 1e-3)
            total += own[1 + n + j] * math.log(p / (1 - p))
        out.append(1 / (1 + math.exp(-max(-30, min(30, total)))))
    return out


def test_toxicity_scores(spark):
    docs, labels = corpus(spark)
    chain = toxicity.default_chain(docs, labels)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    got = {}
    for r in toxicity.score(docs, chain).collect():
        got.setdefault(r.doc_id, []).append((r.p_low_quality, r.p_toxic, r.rejected))
    for i, rows in got.items():
        want = sorted((*p, p[-1] >= chain.threshold) for p in (plain_toxicity(chain, t) for t in texts[i]))
        assert [x for r in sorted(rows) for x in r] == pytest.approx([x for r in want for x in r], abs=1e-6)
    kept = sorted((r.doc_id or -1, r.text or "") for r in toxicity.accepted(docs, chain).collect())
    assert kept == sorted((i or -1, t or "") for i, own in texts.items() for t in own if plain_toxicity(chain, t)[-1] < chain.threshold)
    assert toxicity.score(docs.limit(0), chain).count() == 0 and toxicity.accepted(docs.limit(0), chain).count() == 0


class Page:
    """Random pages as nested lists, written as HTML in one way and as text in another."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def word(self):
        return "".join(self.rng.choices("abcd<&é", k=self.rng.randrange(1, 5)))

    def blocks(self, depth):
        kinds = ["p", "div", "list", "hidden", "text"] if depth < 4 else ["p", "text"]
        return [(k := self.rng.choice(kinds), self.inside(k, depth)) for _ in range(self.rng.randrange(1, 4))]

    def inside(self, kind, depth):
        if kind in ("p", "text"):
            return [(self.word(), self.rng.random() < 0.3, self.rng.random() < 0.15) for _ in range(self.rng.randrange(1, 4))]
        return [self.blocks(depth + 1) for _ in range(self.rng.randrange(1, 4))] if kind == "list" else self.blocks(depth + 1)


def written(blocks):
    out = []
    for kind, inside in blocks:
        if kind in ("p", "text"):
            words = [f"<b>{w}</b>" if bold else f"<i hidden>{w}</i>" if gone else w for w, bold, gone in ((w.replace("&", "&amp;").replace("<", "&lt;"), b, g) for w, b, g in inside)]
            text = " \n".join(words)
            out.append(f"<p>{text}" if kind == "p" else f"<div>{text}</div>")
        elif kind == "list":
            out.append("<ul>" + "".join(f"<li>{written(b)}" for b in inside) + "</ul>")
        else:
            out.append(f"<div{' style=display:none' if kind == 'hidden' else ''}>{written(inside)}</div>")
    return "".join(out)


def shown(blocks, lists=0):
    """Lines, with None where an empty line is due."""
    out = []
    for kind, inside in blocks:
        if kind in ("p", "text"):
            line = " ".join(w for w, bold, gone in inside if bold or not gone)
            gap = [None] if kind == "p" else []
            out += [*gap, *([line] if line else []), *gap]
        elif kind == "list":
            gap = [None] if lists == 0 else []
            rows = []
            for item in inside:
                own = joined(shown(item, lists + 1))
                rows += [f"{'*o-'[min(lists, 2)] if i == 0 else ' '} {x}".rstrip() if x or i == 0 else "" for i, x in enumerate(own)]
            out += [*gap, *rows, *gap]
        elif kind == "div":
            out += shown(inside, lists)
    return out


def joined(lines):
    out, gap = [], False
    for x in lines:
        if x is None:
            gap = True
            continue
        if gap and out:
            out.append("")
        gap = False
        out.append(x)
    return out


def test_generated_pages():
    for seed in range(400):
        page = Page(seed).blocks(0)
        assert extract(written(page)).split("\n") == (joined(shown(page)) or [""]), seed
