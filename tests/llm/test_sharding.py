"""The k-d tree: cuts by rank whatever the values are, and a small tree against brute force."""

import collections

import numpy as np
import pytest
from test_operators import words

from weft.llm import sharding


def shards_of(spark, rows, dims, shards):
    kinds = ", ".join(f"{d} double" for d in dims)
    df = spark.createDataFrame(rows, f"g long, w long, {kinds}").repartition(3)
    return {r["g"]: r["shard"] for r in sharding.kd_shards(df, "w", "g", list(dims), shards).collect()}


@pytest.mark.parametrize("value", [lambda i: 2.0 ** (-5 * i), lambda i: -(3.0 ** (3 * i)), lambda i: (-1.0) ** i * 10.0 ** (i - 100), lambda i: 1 + i * 2.0**-52, lambda i: float(i == 0), lambda i: 5e-324 * i])
@pytest.mark.parametrize("shards", [2, 7])
def test_values_of_any_magnitude(spark, value, shards):
    """200 points of one weight are dealt evenly, in the order of their values."""
    rows = [(int(k), 10, value(i)) for i, k in enumerate(np.random.default_rng(1).permutation(10**6)[:200])]
    got = shards_of(spark, rows, ["x"], shards)
    sizes = collections.Counter(got.values())
    assert len(sizes) == shards
    assert max(sizes.values()) - min(sizes.values()) <= 4
    by_value = sorted(rows, key=lambda r: (r[2], r[0]))
    assert [got[r[0]] for r in by_value] == sorted(got.values())


def test_keys_that_lie_close_together(spark):
    """Points of one value are cut by key, also where keys differ by less than doubles tell."""
    base = 2**62
    got = shards_of(spark, [(base + i, 1, 0.0) for i in range(90)] + [(-base, 1, 0.0)], ["x"], 3)
    sizes = collections.Counter(got.values())
    assert len(sizes) == 3
    assert max(sizes.values()) - min(sizes.values()) <= 2
    order = [got[k] for k in sorted(got)]
    assert order == sorted(order)


def brute(points, shards, scale):
    """{group: leaf's first shard}: points are (group, weight, values), the cut is the boundary nearest the goal."""
    if shards == 1 or len(points) == 1:
        return {p[0]: 0 for p in points}
    x = np.array([p[2] for p in points])
    dim = int(np.argmax((x.max(axis=0) - x.min(axis=0)) / scale))
    own = sorted(points, key=lambda p: (p[2][dim], p[0]))
    total = sum(p[1] for p in own)
    before = np.cumsum([p[1] for p in own])[:-1]
    at = int(np.argmin(np.abs(before - total * (shards // 2) / shards))) + 1
    left = min(max(round(shards * int(before[at - 1]) / total), 1), shards - 1)
    out = brute(own[:at], left, scale)
    return out | {g: s + left for g, s in brute(own[at:], shards - left, scale).items()}


def test_a_small_tree_against_brute_force(spark):
    rng = np.random.default_rng(9)
    points = [(int(k), int(w), (float(a), float(b))) for k, w, a, b in zip(rng.permutation(10**6)[:160], rng.integers(90, 110, 160), rng.random(160) * 50, rng.exponential(3.0, 160) ** 3, strict=True)]
    x = np.array([p[2] for p in points])
    scale = x.max(axis=0) - x.min(axis=0)
    for shards in (2, 5, 8):
        assert shards_of(spark, [(g, w, *v) for g, w, v in points], ["a", "b"], shards) == brute(points, shards, scale)


def test_documents_with_exponential_metadata(spark):
    docs = spark.createDataFrame([(i, words(20, i), 2.0 ** (-5 * i)) for i in range(200)], "doc_id long, text string, m double")
    sizes = collections.Counter()
    for r in sharding.shard_documents(docs, shards=2, dims=("m",)).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 2
    assert max(sizes.values()) < 1.03 * min(sizes.values())
