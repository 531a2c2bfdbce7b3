import math
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def check(rows, got, components=32):
    """Against NumPy's covariance and eigenvectors of all kept rows at once."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, size = len(kept), len(kept[0][1])
    x = np.array([v for _, v in kept], float)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[: min(components, size)]
    sums = [sum(v[d] for _, v in kept) for d in range(size)]
    assert len(got) == n * len(order)
    exact = {}
    for i, v in kept:
        exact.setdefault(i, set()).add(sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)))
    by = {}
    for r in got:
        assert r["n"] == n and int(r["deviation"]) in exact[r["vec_id"]] and r["identity_error"] < 1e-4
        assert abs(r["explained"] - values[order[r["component"] - 1]] / values.sum()) < 1e-9
        by.setdefault(r["component"], []).append((r["vec_id"], r["whitened"]))
    for c, found in by.items():
        want = sorted(((i, y) for (i, _), y in zip(kept, centred @ vectors[:, order[c - 1]] / math.sqrt(values[order[c - 1]]), strict=True)), key=lambda t: (str(t[0]), t[1]))
        flipped = sorted(((i, -y) for i, y in want), key=lambda t: (str(t[0]), t[1]))
        found.sort(key=lambda t: (str(t[0]), t[1]))
        assert any(np.allclose([y for _, y in found], [y for _, y in w], atol=1e-6) for w in (want, flipped))


def sample(n, size, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, 1, (n, size)) * np.linspace(1, 3, size) + rng.normal(0, 2, size)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)  # several blocks, the last one not full
    rows = sample(900, 12)
    rows += rows[:20] + [(None, rows[5][1]), (2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] * 12), (2004, [float("-inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "row", "values", "component", "whitened")})
    got = whitening.whitened(df.repartition(7), 5).collect()
    check(rows, got, 5)
    assert isinstance(got[0]["deviation"], Decimal)


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).repartition(9).filter("id % 3 > 0")
    got = [r["row"] for r in whitening.numbered(df).collect()]
    assert sorted(got) == list(range(666))


def test_large_offsets_lose_nothing(spark):
    """Entries far from zero, with small differences."""
    rows = [(i, [5000.0 + a, -3000.0 + b]) for i, (_, (a, b)) in enumerate(sample(300, 2))]
    check(rows, whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())


def test_other_lengths_flat_and_empty(spark):
    rows = sample(50, 3)
    odd = [(100, [1.0]), (101, [1.0, 2.0])]
    check(rows, whitening.whitened(spark.createDataFrame(rows + odd, SCHEMA)).collect())
    flat = [(i, [a, 0.5, a]) for i, (_, (a,)) in enumerate(sample(50, 1))]
    got = whitening.whitened(spark.createDataFrame(flat, SCHEMA)).collect()
    assert len(got) == 50 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-9
    for none in ([], [(1, None)], [(1, [1.0, 2.0])] * 4):
        assert whitening.whitened(spark.createDataFrame(none, SCHEMA)).count() == 0
