"""Joins on crowded skies and repeated places: equal to brute force, without a broadcast of what a plan repeats, and without all pairs."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import scalar as S
from skyloom.operators import sky
from skyloom.plans import aggregate_queries

PLACED = "catalog_index long, sca int, ord string, xsca double, ysca double, mag double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_isolation_broadcasts_no_repeated_rows(spark):
    """Crowds, repeated ids, pairs right at the radius, missing and odd places."""
    rng = np.random.default_rng(21)
    rows = [(i, int(rng.integers(1, 3)), "1", float(x), float(y), 5.0) for i, (x, y) in enumerate(np.concatenate([rng.uniform(0, 3000, (250, 2)), rng.uniform(0, 90, (150, 2))]))]
    rows += [(900, 3, "1", 0.0, 0.0, 1.0), (901, 3, "1", 100.0, 0.0, 1.0), (902, 4, "1", 7.0, 7.0, 1.0), (902, 4, "1", 8.0, 7.0, 1.0)]
    rows += [(903, 4, "1", None, 7.0, 1.0), (904, 4, "1", float("nan"), 7.0, 1.0), (905, 4, "1", float("inf"), 7.0, 1.0), (906, None, "1", 7.0, 7.0, 1.0), (907, None, "1", 7.0, 7.0, 1.0)]
    df = spark.createDataFrame(rows, PLACED)
    for radius in (100.0, 40.0):
        out = sky.without_neighbour(df, df, radius)
        assert "BroadcastHashJoin" not in plan(out) and "BroadcastNestedLoopJoin" not in plan(out)
        alone = []
        for i, s, o, x, y, _ in rows:
            near = [k for k in rows if k[0] != i and s is not None and k[1:3] == (s, o) and None not in (x, y, k[3], k[4]) and np.hypot(x - k[3], y - k[4]) <= radius]
            alone += [] if near else [i]
        assert sorted(r["catalog_index"] for r in out.collect()) == sorted(alone) and len(alone) > 20


def test_counted_sides_are_not_broadcast_by_estimate(spark, monkeypatch):
    few = spark.createDataFrame([(i, float(i), 0.0) for i in range(30)], "id long, ra0 double, dec0 double")
    many = spark.createDataFrame([(i, float(i), 0.0) for i in range(30)], "catalog_index long, ra double, dec double")
    assert "BroadcastHashJoin" in plan(sky.cone_join(many, few, 0.5))
    monkeypatch.setattr(sky, "FEW", 10)
    got = sky.cone_join(many, few, 0.5)
    assert "BroadcastHashJoin" not in plan(got) and got.count() == 30


def crowded(rng, n, names):
    """Half of the rows at three places, half of the rest within a thousandth of a degree."""
    at = np.concatenate([np.repeat(rng.uniform(10, 11, (3, 2)), n // 6, 0), 10.5 + rng.uniform(0, 1e-3, (n // 4, 2)), rng.uniform(10, 11, (n // 4, 2))])
    return [(int(i), float(x), float(y - 10)) for i, (x, y) in zip(rng.permutation(len(at)), at, strict=True)], f"{names[0]} long, {names[1]} double, {names[2]} double"


def test_nearest_match_searches_places_once_and_small_first(spark, monkeypatch):
    rng = np.random.default_rng(22)
    cat = spark.createDataFrame(*crowded(rng, 1200, ("catalog_index", "ra", "dec")))
    targets = spark.createDataFrame(*crowded(rng, 600, ("k", "ra0", "dec0")))
    pairs, join = [], sky.cone_join
    monkeypatch.setattr(sky, "cone_join", lambda *a: (pairs.append(join(*a).count()), join(*a))[1])
    got = {r["k"]: (r["sep_arcsec"], r["catalog_index"]) for r in sky.nearest_match(targets, cat, "k").collect()}
    sep = (S.haversine("ra", "dec", "ra0", "dec0")).alias("sep")
    want = {r["k"]: (r["m"]["sep"] * 3600, r["m"]["catalog_index"]) for r in targets.crossJoin(cat).groupBy("k").agg(F.min(F.struct(sep, "catalog_index")).alias("m")).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert sum(pairs) < 20 * 1800  # all pairs within the first radius: over 100,000


def test_nearest_within_searches_places_once_and_small_first(spark, monkeypatch):
    rng = np.random.default_rng(23)
    b = spark.createDataFrame(*crowded(rng, 1200, ("id_b", "ra_b", "dec_b")))
    a = spark.createDataFrame(*crowded(rng, 600, ("id_a", "ra_a", "dec_a")))
    pairs, join = [], sky.pairs_within
    monkeypatch.setattr(sky, "pairs_within", lambda *x: (pairs.append(join(*x).count()), join(*x))[1])
    got = sorted(map(tuple, sky.nearest_within(a, b, 0.05).collect()))
    d = F.sqrt(F.pow((F.col("ra_a") - F.col("ra_b")) * F.cos(F.radians("dec_a")), 2) + F.pow(F.col("dec_a") - F.col("dec_b"), 2)).alias("d")
    want = a.crossJoin(b).withColumn("d", d).filter("d <= 0.05").groupBy("id_a").agg(F.min(F.struct("d", "id_b")).alias("m")).select("id_a", "m.id_b", "m.d")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 300
    assert sum(pairs) < 20 * 1800


def test_extraction_makes_one_row_a_sample(spark):
    """Fluxes equal a loop's, also for repeated ids and absent pixels; samples are neither repeated nor shuffled."""
    rng = np.random.default_rng(24)
    pix = {(int(s), int(y), int(x)): float(rng.integers(1, 50)) for s, y, x in zip(rng.integers(1, 19, 9000), rng.integers(0, 64, 9000), rng.integers(0, 64, 9000), strict=True)}
    ids = [*range(40), 39, 39]
    views = {
        "sources": spark.createDataFrame([(i,) for i in ids], "catalog_index long"),
        "pixels": spark.createDataFrame([(*k, v) for k, v in pix.items()], "sca int, y int, x int, value_a double"),
        "spectra": spark.createDataFrame([(i, [0.5, -1.5, 2.5]) for i in range(30, 60)], "vec_id long, embedding array<float>"),
    }
    out = aggregate_queries.extract_spectrum(views.__getitem__)
    want = {(c, i): ids.count(c) * 2.5 * sum(pix.get((1 + c % 18, (i + c) % 64, i + k), 0.0) for k in range(-2, 3)) for c in ids for i in range(64)}
    assert {(r["src"], r["i"]): r["flux"] for r in out.collect()} == want and out.count() == len(want)
    assert plan(out).split("Generate explode")[0].count("Exchange hashpartitioning") == 0  # above the samples, nothing is shuffled
    level = {r["src"]: (r["n"], r["level"]) for r in aggregate_queries.expected_vs_extracted(views.__getitem__).collect()}
    assert level == {c: (3, float(np.median([want[c, i] - 100 * f for i, f in enumerate((0.5, 1.5, 2.5))]))) for c in range(30, 40)}
