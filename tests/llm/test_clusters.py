import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import clusters

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=40, rounds=5, size=64):
    """Plain rounds over all distances, in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((squared(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = assign()
    inertia = {j: sum(d for d, c in of if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, of, strict=True)), key=str)


def blobs(rng, n, size, spread=0.3):
    centers = rng.normal(0, 5, (12, size))
    return (centers[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, size))).astype(np.float32)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 0.01, (300, 8)), 2).astype(np.float32)  # few values: many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, v) for i, v in rows[:50]] + [(None, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [0.1] * 7), (903, [0.1] * 9)]
    rows += [(904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7), (906, [None] + [0.0] * 7)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "cluster", "distance", "lower", "squared")})
    got = clusters.cluster(df, size=8).drop("scanned").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, size=8)


def test_most_vectors_are_not_scanned(spark):
    x = blobs(np.random.default_rng(5), 4000, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = clusters.cluster(spark.createDataFrame(rows, SCHEMA), k=12, size=16).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute(rows, k=12, size=16)
    assert got[0]["scanned"] < 0.5 * 6 * len(rows)


def test_bounds_hold_and_are_below_the_drift():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(200):
        k, size = rng.integers(2, 9), rng.integers(1, 6)
        before = rng.normal(0, 10, (k, size))
        now = before + rng.normal(0, rng.choice([0.1, 1, 8]), (k, size)) * (rng.random((k, 1)) < 0.7)
        radius = rng.uniform(0, 6, k)
        loose = clusters.loosening(clusters.Centroids(now, before, radius))
        for i in range(k):
            way = rng.normal(0, 1, (400, size))
            x = before[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.random((400, 1)) ** (1 / size)
            fall = np.linalg.norm(x[:, None] - before, axis=2) - np.linalg.norm(x[:, None] - now, axis=2)
            fall[:, i] = 0
            assert fall.max() <= loose[i] + 1e-9
            drift = np.delete(np.linalg.norm(now - before, axis=1), i).max()
            assert loose[i] <= drift * (1 + 1e-6) + 1e-8
            less += loose[i] < 0.9 * drift
    assert less > 100


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25])]
    got = clusters.cluster(spark.createDataFrame(rows, SCHEMA), size=2).drop("scanned").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, size=2)
    assert clusters.cluster(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
