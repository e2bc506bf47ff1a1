import struct
import zlib

import numpy as np
import pytest

from tallyspark.llm import media


def by_hand(rows, kinds):
    h, w = rows.shape
    out = [[0] * w for _ in range(h)]
    for r in range(h):
        for c in range(w):
            a = out[r][c - 1] if c else 0
            b = out[r - 1][c] if r else 0
            d = out[r - 1][c - 1] if r and c else 0
            p = a + b - d
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out[r][c] = (int(rows[r, c]) + [0, a, b, (a + b) // 2, best][kinds[r]]) % 256
    return np.array(out, np.uint8)


@pytest.mark.parametrize("seed", range(8))
def test_all_filters(seed):
    rng = np.random.default_rng(seed)
    rows, kinds = rng.integers(0, 256, (17, 9), np.uint8), rng.integers(0, 5, 17, np.uint8)
    assert (media.unfilter(rows, kinds) == by_hand(rows, kinds)).all()


def test_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for h in (1, 2, 31, 32, 33, 500):
        x = np.cumsum(rng.integers(0, 3, (h, 64)), 0).astype(np.uint8)
        png = media.write_png(x)
        assert (media.read_png(png) == x).all()
        assert len(media.cosine_hash(x)) == 8
    bad = bytearray(png)
    bad[60] ^= 1
    for broken in (bytes(bad), png[:-12], b"x" + png[1:]):
        with pytest.raises(media.MediaError):
            media.read_png(broken)


def test_query_like_rows(spark):
    texts = [(1, None), (2, ""), (3, "a" * 64), (3, "a" * 64), (4, "é" * 5000), (None, "x\0y")]
    df = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, media string")
    got = media.load(media.store(df)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = next((t or "") for i, t in texts if i == r.doc_id).encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert bytes(r.payload) == want and r.n_bytes == len(raw) and r.crc == zlib.crc32(want[-64:])
        assert struct.unpack(">I", bytes(r.media)[16:20])[0] == 64
    assert media.load(media.store(df.limit(0))).count() == 0


def plain_hash(rows):
    """The feature by its definition: mean of each of 32 x 32 areas, cosine sums of the 8 x 8 lowest frequencies, above their median or not."""
    import math
    import statistics

    h, w = len(rows), len(rows[0])
    edge = lambda n, i: range(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) if n >= 32 else [i * n // 32]
    small = [[statistics.fmean(rows[y][x] for y in edge(h, i) for x in edge(w, j)) for j in range(32)] for i in range(32)]
    low = [round(sum(small[i][j] * math.cos(math.pi * u * (2 * i + 1) / 64) * math.cos(math.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    return int("".join("1" if x > middle else "0" for x in low), 2).to_bytes(8, "big")


def test_hash_against_plain_version():
    rng = np.random.default_rng(4)
    for h in (1, 5, 32, 50, 131):
        x = np.cumsum(rng.integers(0, 9, (h, 64)), 0).astype(np.uint8)
        assert media.cosine_hash(x) == plain_hash(x.tolist())


def test_images_are_bounded_by_their_headers():
    png = media.write_png(np.zeros((4, 64), np.uint8))
    bomb = png[:8] + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 4, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(1 << 24))) + media._chunk(b"IEND", b"")
    with pytest.raises(media.MediaError, match="wrong number"):
        media.read_png(bomb)
