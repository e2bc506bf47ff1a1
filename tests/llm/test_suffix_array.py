import numpy as np
import pytest

from tallyspark.llm.suffix_array import Regions


@pytest.mark.parametrize("seed", range(12))
def test_against_sorting(seed):
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(0, 1 + seed % 3, rng.integers(0, 90), np.uint8) + 97 * (seed % 2)) for _ in range(12)]
    strings += [strings[3], strings[3] + b"q", strings[5][5:]]
    r = Regions(strings)
    suffixes = [(s[i:], k) for k, s in enumerate(strings) for i in range(len(s) + 1)]
    order = r.suffix_array()
    want = sorted(range(r.n), key=lambda p: (suffixes[p][0], suffixes[p][1]))
    assert order.tolist() == want

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    got = r.common_prefixes(order, 1000)
    assert got[1:].tolist() == [shared(suffixes[a][0], suffixes[b][0]) for a, b in zip(want, want[1:])]
    for length in (1, 5, 30):
        tops = [s[:length] if len(s) >= length else None for s, _ in suffixes]
        assert r.repeated(length).tolist() == [t is not None and tops.count(t) > 1 for t in tops]
