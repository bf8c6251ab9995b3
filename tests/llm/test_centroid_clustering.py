"""Clusters against plain Lloyd's rounds in whole numbers over all rows."""

import hashlib
import math
import random

import pytest
from quire.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<float>, cluster int, q string, copies int"


def brute(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        return [min((d, j) for j, d in enumerate(ds)) for ds in far]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    sums = {j: sum(d for d, c in at if c == j) for j in range(k)}
    fits = lambda x: x if x < 2**63 else None
    return [(i, c, d, fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at, strict=True)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    return sorted(map(repr, map(tuple, cc.cluster_vectors(df, **how).collect())))


def vectors(n, seed, spread=0.3):
    r = random.Random(seed)
    f = lambda x: float(__import__("numpy").float32(x))
    middles = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [f(m + r.gauss(0, spread)) for m in middles[i % 5]]) for i in range(n)]


def test_same_as_brute_force(spark):
    rows = vectors(300, 1)
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [None] + [0.0] * 63), (906, [0.0] * 65)]
    same = [(1000 + i, rows[0][1]) for i in range(200)] + [rows[3]] * 4 + [(7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (950, [0.0] * 64)]
    every = rows + bad + same
    assert run(spark, every) == sorted(map(repr, brute(every)))


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_rows(spark, n):
    rows = vectors(n, 2) + [(50, None)]
    assert run(spark, rows) == sorted(map(repr, brute(rows)))


def test_equal_vectors_leave_empty_clusters_as_they_are(spark):
    rows = [(i, [0.25] * 64) for i in range(20)] + [(20 + i, [-3.0 + i] * 64) for i in range(3)]
    assert run(spark, rows) == sorted(map(repr, brute(rows)))


def test_large_components_are_exact(spark):
    """Beyond what doubles and products of longs hold."""
    r = random.Random(5)
    rows = [(i, [float(r.randint(-130_000, 130_000)) for _ in range(64)]) for i in range(40)]
    assert run(spark, rows) == sorted(map(repr, brute(rows)))
    assert run(spark, [*rows, (99, [131_072.0] + [0.0] * 63)]) == run(spark, rows)


def test_joins_by_shuffle_and_broadcast_agree(spark, monkeypatch):
    rows = vectors(120, 3) + [(500 + i, vectors(1, 3)[0][1]) for i in range(60)]
    want = sorted(map(repr, brute(rows)))
    for hot in (1, 4, 10**6):
        monkeypatch.setattr(cc, "HOT", hot)
        assert run(spark, rows) == want
