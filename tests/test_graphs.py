import hashlib
import random

import pytest

from tallyspark.operators import catalog, graphs


def plain_claims(groups):
    """groups: grp -> (members, explicit, old ids by member)."""
    rows = sorted(((e is None, min(m), g, e, sorted({old[i] for i in m if i in old})) for g, (m, e, old) in groups.items()))
    claimed, out = set(), {}
    for _, least, g, explicit, olds in rows:
        found = explicit or next((o for o in olds if o not in claimed), "q_" + hashlib.sha256(least.encode()).hexdigest()[:32])
        assert found not in claimed
        claimed.add(found)
        out[g] = found
    return out


def claims(spark, groups):
    members = spark.createDataFrame([(g, i, e) for g, (m, e, _) in groups.items() for i in m], "grp string, id string, explicit string")
    assigned = spark.createDataFrame([(i, o) for _, _, old in groups.values() for i, o in old.items()], "id string, old_id string")
    return {r.grp: r.question_id for r in catalog.claim_ids(members, assigned).collect()}


@pytest.mark.parametrize("n", [3, 12, 1000])
def test_claims_along_a_chain(spark, n):
    """Each group holds a member of two neighbouring old ids, so every claim hangs on the one before it."""
    order = [f"{(i * 7919) % n:05d}" if n > 12 else f"{i:05d}" for i in range(n)]
    groups = {f"g{i}": ([f"m{order[i]}a", f"m{order[i]}b"], None, {f"m{order[i]}a": f"o{i:04d}", f"m{order[i]}b": f"o{i + 1:04d}"}) for i in range(n)}
    groups["g0"] = ([f"m{order[0]}a"], None, {f"m{order[0]}a": "o0001"})
    groups["x"] = (["zz"], "o0002", {"zz": "o0000"})
    assert claims(spark, groups) == plain_claims(groups)


def test_claims_of_random_groups(spark):
    rng = random.Random(8)
    groups = {}
    for i in range(150):
        m = [f"{rng.randrange(10**6):06d}-{i}-{k}" for k in range(rng.randrange(1, 4))]
        groups[f"g{i}"] = (m, f"e{i}" if rng.random() < 0.1 else None, {x: f"o{rng.randrange(60):02d}" for x in m if rng.random() < 0.7})
    first = min(groups["g0"][0])  # the id that another group would be given anew
    groups["y"] = (["zzz"], None, {"zzz": "q_" + hashlib.sha256(first.encode()).hexdigest()[:32]})
    assert claims(spark, groups) == plain_claims(groups)


def test_claims_that_collide_fail(spark):
    with pytest.raises(Exception, match="duplicate question_id"):
        claims(spark, {"a": (["1"], "same", {}), "b": (["2"], "same", {})})


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(400)] + [(2000, 2001 + i) for i in range(50)] + [(5000, 5000)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            top[hi] = lo
    got = {r.vertex: r.component for r in graphs.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_long_chains_are_no_cycles(spark):
    rows = [(f"a{i}", f"a{i + 1}") for i in range(1000)] + [("b", "a500"), ("c", "d"), ("z", None)]
    got = {r.old_id: r.target for r in catalog.resolve(spark.createDataFrame(rows, "old_id string, target string")).collect()}
    assert got == {**{f"a{i}": "a1000" for i in range(1000)}, "b": "a1000", "c": "d"}
    for ring in ([("a", "a")], [("a", "b"), ("b", "c"), ("c", "a")], [("x", "a"), ("a", "b"), ("b", "a"), ("p", "q")]):
        with pytest.raises(ValueError, match="cycle"):
            catalog.resolve(spark.createDataFrame(ring, "old_id string, target string"))
    assert catalog.resolve(spark.createDataFrame([], "old_id string, target string")).count() == 0
