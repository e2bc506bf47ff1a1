import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import bpe, toxicity

from .test_jaccard import brute as jaccard_brute
from .test_substrings import brute as substring_brute

import public_tokenizers as P
import re


def hit_share(text, items):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    w, hit = words(text), set()
    for item in items:
        b = words(item)
        for k in range(max(1, len(b) - 12)):
            win = b[k : k + 13]
            hit.update(p for s in range(len(w) - len(win) + 1) if win and w[s : s + len(win)] == win for p in range(s, s + len(win)))
    return len(hit), len(w)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choices("abcdefgé", k=rng.randrange(2, 7))) for _ in range(n))
    items, shared = [say(20) for _ in range(4)], [say(90) for _ in range(3)]
    rows = [(0, None), (1, "")]
    for i in range(2, 150):
        parts = [say(rng.randrange(10, 120))]
        if i % 5 == 0:
            parts.insert(0, "idiot moron clown")
        if i % 7 == 0:
            parts.append(rng.choice(items))
        if i % 6 == 0:
            parts += [rng.choice(shared), say(40)]
        rows.append((i, " ".join(parts)))
    rows += [(200 + k, rows[k][1] + " end") for k in range(20, 40)] + [(300, rows[22][1]), rows[23]]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i, _ in rows[2:150]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def test_stages_against_brute_force(spark, tables):
    folder, rows, items = tables
    chain = toxicity.default_chain(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    index = chain.features
    kept = [(i, t) for i, t in rows if chain.predict([[index[f] for f in toxicity.held(t or "") if f in index]])[0, -1] < chain.threshold]
    assert sum(i % 5 == 0 and 5 <= i < 150 for i, _ in kept) <= 3 and len(kept) > 110
    component = {r[0]: r[2] for r in jaccard_brute(kept)}
    kept = sorted({(i, t) for i, t in kept if component[i] == i}, key=lambda x: x[0])
    cut = substring_brute([t for _, t in kept], 400)
    kept = [(i, data.decode(errors="ignore")) for (i, _), (_, data, _) in zip(kept, cut)]
    clean = [(i, t) for i, t in kept if not (lambda h, n: h and 20 * h >= n)(*hit_share(t, items))]
    coder = bpe.coder(open(bpe.default_vocabulary(), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    want = sorted((i, hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean)
    got = sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and 60 < len(got) < len(rows) and len(clean) < len(kept)


def test_stages_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").withColumn("uid", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables[0]).dtypes == docs.drop("uid").dtypes


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tables, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{tables[0]}/{name}.parquet")
        (table.limit(0) if name == empty else table.limit(30)).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()
    assert (len(got) == 0) == (empty == "documents")
