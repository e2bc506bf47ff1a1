import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tallyspark.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(open(bpe.default_vocabulary(), "rb").read())


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def check(coder, library, texts):
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in data])).astype(np.int64)
    got = coder.encode(b"".join(data), offsets)
    for text, ids in zip(texts, got):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == library.encode_ordinary(text), repr(text[:80])
        assert coder.decode(ids)[0].decode() == text


def test_planned_texts(coder, library):
    check(coder, library, ["", " ", "  ", "a", "", "it's we're I'll 'tis ''s x'd", "don't  'lly 've'\n\n 's", "  lead\n\ttail  ", "a\n b\r\n\r\n c", "x" * 5000, "ab" * 3000 + " " * 700, "'", "''", "'r", "12 34x   y\u0085z", "\x1c\x1d a", "日本語 テキスト🙂🙂 é"])


def test_random_texts(coder, library):
    rng = random.Random(5)
    alphabet = list("abstrevlmd'  \n\t.,!?0 1Aé½漢 　🙂")
    check(coder, library, ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(4000)])


def test_every_code_point(coder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    data = [t.encode() for t in texts]
    got = coder.encode(b"".join(data), np.append(0, np.cumsum([len(x) for x in data])).astype(np.int64))
    off = [t for t, ids in zip(texts, got) if np.frombuffer(ids, "<u4").tolist() != library.encode_ordinary(t)]
    assert not off, [hex(ord(t[1])) for t in off]
