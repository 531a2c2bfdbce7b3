"""Known values, invariants and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import scalar as S
from skyloom.operators import cuts, fits, footprint, pixels, quality, sky, spectra
from skyloom.operators.quantiles import exact_quantiles, ranks, rows_before
from skyloom.sources import readers

NAN = float("nan")


@pytest.fixture(scope="module")
def cut_rows(spark):
    mags, radii = [20, 26.9, 27.1, 21, NAN, 18, 27.5], [0.3, 0.2, 0.2, 0.0, 0.3, 0.0, 0.0]
    rows = [(10 + i, "SER" if i < 5 else "PSF", float(m), r) for i, (m, r) in enumerate(zip(mags, radii, strict=True))]
    return spark.createDataFrame(rows, "id long, type string, mag double, half_light_radius double")


RULES = [{"column": "mag", "op": "le", "value": 27.0}, {"column": "half_light_radius", "op": "gt", "value": 0, "types": ["SER"]}]


def test_cuts_known_rows(cut_rows):
    assert [r["id"] for r in cuts.source_cuts(cut_rows, RULES).orderBy("id").collect()] == [10, 11, 15]
    assert [r["removed"] for r in cuts.source_cut_attribution(cut_rows, RULES).orderBy("rule").collect()] == [3, 1]


def test_magnitude_cuts_of_flux(spark):
    flux = spark.createDataFrame([(1, "SER", 1e-8), (2, "SER", 0.0), (3, "SER", -1.0), (4, "SER", NAN), (5, "SER", None)], "id long, type string, f double")
    keep = lambda op: [r["id"] for r in cuts.source_cuts(flux, [{"column": "f", "op": op, "value": 20.0}]).orderBy("id").collect()]
    assert keep("mag_le") == [1]
    assert keep("mag_ge") == [1, 2, 3]


@pytest.mark.parametrize("rules", [{}, [{"column": "mag"}], [{"column": "mag", "op": "eval", "value": 1}], [{"column": "mag", "op": "between", "value": [1]}], [{"column": "no", "op": "lt", "value": 1}], [{"column": "mag", "op": "lt", "value": 1, "more": 2}]])
def test_bad_rules_are_refused(cut_rows, rules):
    with pytest.raises((TypeError, ValueError)):
        cuts.source_cuts(cut_rows, rules)


def test_cells_known_values(spark):
    rows = spark.createDataFrame([(0, 0), (0, 11), (1, 0), (1, 47), (12, 5)], "k int, p long").withColumn("u", S.uniq_pack(F.col("k"), F.col("p")))
    got = rows.select("u", S.uniq_order("u").alias("k2"), S.uniq_pix("u").alias("p2"), "k", "p").collect()
    assert [r["u"] for r in got][:4] == [4, 15, 16, 63]
    assert all((r["k"], r["p"]) == (r["k2"], r["p2"]) for r in got)


def test_sky_cells_nest_and_cover_equal_areas(spark):
    n = 20000
    rows = spark.range(n).select(((F.col("id") * 0.6180339887498949 % 1) * 360).alias("ra"), F.degrees(F.asin(2 * (F.col("id") + 0.5) / n - 1)).alias("dec"))
    c = rows.select(S.sky_cell("ra", "dec", 12).alias("fine"), S.sky_cell("ra", "dec", 2).alias("coarse"))
    assert c.filter(S.cell_parent("fine", 10) != F.col("coarse")).count() == 0
    counts = [r["count"] for r in c.groupBy("coarse").count().collect()]
    assert len(counts) == 192 and max(counts) < 1.35 * n / 192 and min(counts) > 0.65 * n / 192
    poles = spark.createDataFrame([(0.0, 90.0), (90.0, -90.0), (359.999, 41.81), (180.0, 0.0)], "ra double, dec double").select(S.sky_cell("ra", "dec", 4).alias("c")).collect()
    assert all(0 <= r["c"] < 12 * 256 for r in poles)


def test_row_ids(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("catalog_index")).repartition(7)
    assert quality.row_ids(df, "catalog_index").filter("row_id <> catalog_index / 3").count() == 0
    sparse = spark.range(5000).select(F.xxhash64("id").alias("catalog_index")).repartition(7)
    got = [r["catalog_index"] for r in quality.row_ids(sparse, "catalog_index").orderBy("row_id").collect()]
    assert got == sorted(r["catalog_index"] for r in sparse.collect())
    placed = sparse.repartitionByRange("catalog_index").withColumn("_place", F.monotonically_increasing_id())
    assert rows_before(placed).count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert quality.row_ids(sparse.limit(0), "catalog_index").count() == 0


def test_cones_over_the_meridian_and_the_poles(spark):
    pts = [(i, (i * 37.7) % 360, -90 + (i * 7.31) % 180) for i in range(800)] + [(9001, 359.95, 0.0), (9002, 0.05, 0.0), (9003, 200.0, 89.5), (9004, 20.0, 89.5), (9005, 0.0, -90.0)]
    src = spark.createDataFrame(pts, "catalog_index long, ra double, dec double")
    centers = spark.createDataFrame([(1, 0.0, 0.0), (2, 110.0, 89.8), (3, 359.9, 0.1), (4, 10.0, -89.9), (5, 180.0, 45.0)], "pointing_id long, ra0 double, dec0 double")
    for radius in (0.2, 3.0, 20.0):
        got = {(r["catalog_index"], r["pointing_id"]) for r in sky.cone_join(src, centers, radius).collect()}
        want = {(r["catalog_index"], r["pointing_id"]) for r in src.crossJoin(centers).filter(S.haversine("ra", "dec", "ra0", "dec0") <= radius).collect()}
        assert got == want
        assert sky.cone_join(src, centers, radius).count() == len(want)


def test_single_precision_is_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "ra float, dec double")
    with pytest.raises(TypeError):
        sky.cone_search(df, 0.0, 0.0, 1.0)


def test_nearest_reaches_far_targets(spark):
    src = spark.createDataFrame([(1, 10.0, 0.0), (2, 200.0, 50.0)], "catalog_index long, ra double, dec double")
    targets = spark.createDataFrame([(1, 10.0001, 0.0), (2, 100.0, -60.0)], "k long, ra0 double, dec0 double")
    got = {r["k"]: (r["catalog_index"], r["good"]) for r in sky.nearest_match(targets, src, "k").collect()}
    assert got == {1: (1, True), 2: (1, False)}


def test_frames_round_trip_and_tangent_plane(spark):
    cal = spark.createDataFrame([(2044.5, 0.11, 100.0, 22.0, -44.0)], "crpix double, pixel_scale double, plate_scale double, xcen double, ycen double")
    df = cal.crossJoin(spark.createDataFrame([(0.5, 4088.5), (100.0, 7.0)], "x double, y double"))
    fx, fy = S.sca_fpa("x", "y")
    bx, by = S.fpa_sca("fx", "fy")
    back = df.withColumns({"fx": fx, "fy": fy}).withColumns({"bx": bx, "by": by}).collect()
    assert all(math.isclose(r["x"], r["bx"], abs_tol=1e-6) and math.isclose(r["y"], r["by"], abs_tol=1e-6) for r in back)
    sky_rows = spark.createDataFrame([(0.1, 10.0, 359.9, 10.0), (359.9, 10.0, 359.7, 10.0)], "ra double, dec double, ra0 double, dec0 double")
    xi, eta = S.tangent_offsets("ra", "dec", "ra0", "dec0")
    a, b = sky_rows.select(xi.alias("xi"), eta.alias("eta")).collect()
    assert math.isclose(a["xi"], b["xi"], abs_tol=1e-9) and math.isclose(a["eta"], b["eta"], abs_tol=1e-9)


def test_binning_known_points(spark):
    pts = spark.createDataFrame([(1, 6.0, 6.0, 1.0), (2, 5.5, 5.5, 1.0), (3, 0.4, 3.0, 1.0), (3, 4088.6, 3.0, 1.0)], "img int, px double, py double, weight double")
    two = {(r["img"], r["y"], r["x"]): r["value"] for r in pixels.bin_bilinear(pts, ["img"], 4088).collect() if r["value"]}
    assert [v for k, v in sorted(two.items()) if k[0] == 1] == [0.25] * 4
    assert {k: v for k, v in two.items() if k[0] == 2} == {(2, 5, 5): 1.0}
    one = {(r["img"], r["y"], r["x"]): r["value"] for r in pixels.bin_floor(pts, ["img"], 4088).collect()}
    assert one == {(1, 5, 5): 1.0, (2, 5, 5): 1.0}


def test_interpolation_clamps(spark):
    curve = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 20.0), (1, 3.0, 0.0)], "k int, x double, y double")
    pts = spark.createDataFrame([(1, -5.0), (1, 0.0), (1, 0.5), (1, 1.0), (1, 2.0), (1, 3.0), (1, 9.0), (2, 1.0)], "k int, at double")
    got = {r["at"]: r["value"] for r in spectra.interp_join(pts, curve, ["k"], "at").collect()}
    assert got == {-5.0: 10.0, 0.0: 10.0, 0.5: 15.0, 1.0: 20.0, 2.0: 10.0, 3.0: 0.0, 9.0: 0.0}


def test_centroid_and_image_diff(spark):
    p = spark.createDataFrame([(1, 0, 0, 0.0), (2, 0, 1, -3.0), (2, 0, 3, 2.0)], "img int, y int, x int, v double")
    got = {r["img"]: r["c"] for r in p.groupBy("img").agg(pixels.centroid("x", F.col("v")).alias("c")).collect()}
    assert math.isnan(got[1]) and got[2] == 3.0
    a = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0)], "img int, y int, x int, value double")
    b = spark.createDataFrame([(1, 0, 0, 1.0), (1, 5, 5, 4.0)], "img int, y int, x int, value double")
    r = pixels.image_diff(a, b, ["img"], 1e-5, 1e-8).collect()[0]
    assert (r["total"], r["worst"], r["failing"]) == (3.0, 4.0, 2)


def test_bad_target_line_is_an_error(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n1.0 2.0\n\n  3.0\t4.0 \n")
    assert readers.read_targets(spark, str(tmp_path / "t.txt")).count() == 2
    (tmp_path / "u.txt").write_text("1.0 2.0 3.0\n")
    with pytest.raises(Exception, match="not two columns"):
        readers.read_targets(spark, str(tmp_path / "u.txt")).collect()


def test_pointing_table(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# comment\nRA DEC BANDPASS\n1.5 2.5 GRISM\n3.5 4.5 PRISM\n")
    got = readers.read_pointings(spark, str(tmp_path / "p.txt"), "GRISM", "RA double, DEC double, BANDPASS string").collect()
    assert [tuple(r) for r in got] == [(1.5, 2.5, "GRISM")]


def test_catalog_columns_keep_units(spark):
    df = readers.as_catalog(spark.createDataFrame([(1.0, 2.0, "x")], "ra double, dec double, other string"))
    assert df.schema["ra"].metadata["unit"] == "deg" and len(df.columns) == 14
    readers_rows = readers.column_dictionary(df).collect()
    assert readers_rows[0]["unit"] == "deg"


def test_labels_of_rules(spark):
    rules = [{"column": "mag", "op": "between", "value": [1, 2], "types": ["PSF", "SER"]}, {"column": "sim", "op": "isin", "value": ["a"]}]
    assert [r["label"] for r in cuts.described(spark, rules).orderBy("rule").collect()] == ["mag between [1, 2] for PSF and SER", "sim isin ['a']"]


def test_quantiles_and_ranks_with_ties_gaps_and_nan(spark):
    rng = np.random.default_rng(3)
    values = {1: rng.normal(size=3001).tolist(), 2: [5.0] * 400 + [1e12, -1e12], 3: [7.5], 4: rng.integers(0, 9, 1000).astype(float).tolist(), 5: [NAN, None]}
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k int, i long, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], F.col("v"), shares).collect()}
    assert set(got) == {1, 2, 3, 4}
    for k, q in got.items():
        assert np.allclose(q, np.quantile(values[k], shares), rtol=1e-12)
    every = exact_quantiles(df, [], F.col("v"), [0.5]).first()["q"]
    assert np.isclose(every[0], np.median([v for _, _, v in rows if v is not None and v == v]))
    assert exact_quantiles(df.limit(0), [], F.col("v"), [0.5]).count() == 0
    ranked = {(r["k"], r["i"]): (r["rank"], r["n"]) for r in ranks(df, ["k"], "v", "i").collect()}
    for k in (1, 2, 3, 4):
        order = sorted(range(len(values[k])), key=lambda i: (values[k][i], i))
        assert all(ranked[k, i] == (n, len(order)) for n, i in enumerate(order))


def test_quantiles_with_an_outlier_and_brackets_that_miss(spark):
    rng = np.random.default_rng(5)
    values = [*rng.normal(size=30_000).tolist(), 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    shares = [0.01, 0.5, 0.999]
    for slack in (2e-4, 0.0, 1.0):
        assert np.allclose(exact_quantiles(df, [], F.col("v"), shares, slack).first()["q"], np.quantile(values, shares), rtol=1e-12)


def test_nearest_within_equals_brute_force_up_to_the_poles(spark):
    rng = np.random.default_rng(4)
    place = lambda n, dec: list(zip(range(n), rng.uniform(0, 360, n).tolist(), dec(n).tolist(), strict=True))
    for dec, tol in ((lambda n: rng.uniform(-90, 90, n), 6.0), (lambda n: rng.uniform(89.5, 90, n), 0.05), (lambda n: rng.uniform(-1, 1, n), 0.5)):
        a, b = spark.createDataFrame(place(120, dec), "id_a long, ra_a double, dec_a double"), spark.createDataFrame(place(150, dec), "id_b long, ra_b double, dec_b double")
        d = F.sqrt(F.pow((F.col("ra_a") - F.col("ra_b")) * F.cos(F.radians("dec_a")), 2) + F.pow(F.col("dec_a") - F.col("dec_b"), 2))
        want = a.crossJoin(b).withColumn("d", d).filter(F.col("d") <= tol).groupBy("id_a").agg(F.min(F.struct("d", "id_b")).alias("m")).select("id_a", "m.id_b", "m.d")
        got = sky.nearest_within(a, b, tol)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_isolated_ladder_and_separated(spark):
    rows = [(1, 0.0, 0.0, 5.0), (2, 90.0, 0.0, 4.0), (3, 1000.0, 0.0, 3.0), (4, 1300.0, 0.0, 2.0), (5, 9000.0, 0.0, 1.0), (6, 5000.0, 5000.0, 6.0), (6, 5001.0, 5000.0, 6.0)]
    df = spark.createDataFrame([(i, 1, "1", x, y, m) for i, x, y, m in rows], "catalog_index long, sca int, ord string, xsca double, ysca double, mag double")
    got = sorted((r["catalog_index"], r["radius"]) for r in sky.isolated_sources(df, 800.0).collect())
    assert got == [(5, 800.0), (6, 800.0), (6, 800.0)]
    crowd = df.filter("catalog_index < 5")
    assert sorted((r["catalog_index"], r["radius"]) for r in sky.isolated_sources(crowd, 800.0).collect()) == [(3, 200.0), (4, 200.0)]
    assert [r["catalog_index"] for r in sky.separated_top_n(df.filter("catalog_index < 6"), 9, 300.0).collect()] == [5, 4, 2]  # 3 is near 4, and 1 near 2


def test_interpolation_of_clustered_samples(spark):
    rng = np.random.default_rng(5)
    x = np.sort(np.concatenate([rng.uniform(0, 0.001, 300), [5.0, 900.0, 1000.0]]))
    y = rng.normal(size=len(x))
    at = np.concatenate([rng.uniform(-1, 1100, 300), rng.uniform(0, 0.001, 300), x])
    curve = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    pts = spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)], "i long, at double")
    got = [r["value"] for r in spectra.interp_join(pts, curve, [], "at").orderBy("i").collect()]
    assert np.allclose(got, np.interp(at, x, y), atol=1e-9)


def test_cells_miss_no_detector(spark):
    """Against every pair of source and detector, at many places, also where traces bend."""
    cal = [(s, o, 2044.5, 0.11, 100.0, (s % 6 - 2.5) * 44.0, (s // 6 - 1.0) * 44.0, "log" if o == "0" else "linear", 1.55, 0.01 * s, 320.0, 5.0, 20.0, 0.3 * s, 4.0, 330.0, -15.0, 0.1, 3.0, -0.4, 0.2, 0.5, 9.0 * int(o) + 1, 0.3, -2.0) for s in range(1, 19) for o in "012"]
    names = "sca ord crpix pixel_scale plate_scale xcen ycen kind wl_ref x00 x10 x01 x11 y00 y10 y01 y11 c0 c1 c2 cx d0 d1 d2 dx".split()
    calibration = S.nested_calibration(spark.createDataFrame(cal, names).withColumn("sca", F.col("sca").cast("int")))
    src = spark.range(600).select("id", ((F.col("id") * 0.6180339887 % 1) * 1.2 - 0.6).alias("xf"), ((F.col("id") * 0.7548776662 % 1) * 0.8 - 0.4).alias("yf"))
    waves = (0.9, 1.45, 2.0)
    df = src.crossJoin(calibration)
    for i, w in enumerate(waves):
        px, py = S.trace_position("xf", "yf", F.lit(w))
        df = df.withColumns({f"px{i}": px, f"py{i}": py})
    most = lambda f, a: f(*(F.col(f"p{a}{i}") for i in range(3)))
    want = df.filter((most(F.greatest, "x") >= -300) & (most(F.least, "x") <= 4388) & (most(F.greatest, "y") >= -300) & (most(F.least, "y") <= 4388)).select("id", "sca", "ord")
    got = footprint.detector_overlap(src, calibration, waves).select("id", "sca", "ord")
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(map(tuple, want.collect())) and len(found) > 500


def test_separated_equals_greedy_pick(spark):
    """Crowded places, ties in brightness, repeated rows, chains of neighbours, missing values."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(1, 3)), "1", float(rng.uniform(0, 900)), float(rng.uniform(0, 900)), float(rng.integers(0, 40))) for i in range(400)]
    rows += [(1000 + i, 3, "1", 90.0 * i, 0.0, float(i)) for i in range(60)] + [(1059, 3, "1", 90.0 * 59, 0.0, 59.0)]
    stays: list[tuple] = []
    for row in sorted(rows, key=lambda x: (x[5], x[0])):
        if all(k[0] == row[0] or k[1:3] != row[1:3] or math.hypot(k[3] - row[3], k[4] - row[4]) > 100 for k in stays):
            stays.append(row)
    extra = [(2000, 1, "1", None, 5.0, 0.5), (2001, 1, "1", 5.0, 5.0, None)]
    df = spark.createDataFrame(rows + extra, "catalog_index long, sca int, ord string, xsca double, ysca double, mag double").withColumn("id", F.lit("clash"))
    want = sorted([(k[5], k[0]) for k in stays] + [(0.5, 2000)])
    for n in (1, 7, 60, 10_000):
        assert [(r["mag"], r["catalog_index"]) for r in sky.separated_top_n(df, n, 100.0).collect()] == want[:n]
    assert sky.separated_top_n(df.limit(0), 5, 100.0).collect() == []


def test_fit_equals_least_squares(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 10))
    y = x @ np.arange(10) + rng.normal(size=300)
    df = spark.createDataFrame([(k, x[i].tolist(), float(y[i])) for k in (1, 2) for i in range(300) if i % k == 0], "k int, f array<double>, y double")
    fit = df.groupBy("k").agg(fits.normal_equations(F.col("f"), 10, F.col("y")).alias("s")).select("k", fits.solved(F.col("s"), 10).alias("w"))
    assert "Python" not in fit._jdf.queryExecution().executedPlan().toString()
    for row in fit.collect():
        assert np.allclose(row["w"], np.linalg.lstsq(x[:: row["k"]], y[:: row["k"]], rcond=None)[0], atol=1e-9)
    flat = df.withColumn("f", F.array(*[F.lit(1.0)] * 10)).groupBy("k").agg(fits.normal_equations(F.col("f"), 10, F.col("y")).alias("s"))
    assert flat.select(fits.solved(F.col("s"), 10).alias("w")).first()["w"][0] is None


def test_campaigns_meet_without_a_shuffle(spark):
    keys = ["catalog_index", "sca", "ord", "line_id"]
    old = spark.range(400).select(F.col("id").alias("catalog_index"), (F.col("id") % 18).alias("sca"), (F.col("id") % 3).alias("ord"), (F.col("id") % 5).alias("line_id"), (F.col("id") * 1.0).alias("x"), F.lit("a").alias("note"))
    new = old.filter("catalog_index % 7 <> 0").withColumn("x", F.col("x") + F.col("sca")).unionByName(old.filter("catalog_index = 1").withColumn("line_id", F.lit(None)))
    got = quality.campaigns(readers.bucketed(old, keys, 4), readers.bucketed(new, keys, 4), keys, ["x"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["catalog_index"], r["x"]) for r in got.collect()) == [(i, float(i % 18)) for i in range(400) if i % 7]


def brute_line(image, x, y, half, narrow, core):
    """Residuals along and across, and flux, from a dense image; None off the image or without flux."""
    xc, yc = math.floor(x + 0.5), math.floor(y + 0.5)
    if min(xc, yc) < half or max(xc, yc) + half >= len(image):
        return None
    box, out = image[yc - half : yc + half + 1, xc - half : xc + half + 1], []
    mid = slice(half - narrow, half + narrow + 1)
    for profile, shift in ((box[:, mid].sum(1), y - yc), (box[mid].sum(0), x - xc)):
        t = np.arange(2 * half + 1) - half - shift
        near = np.abs(t) <= core
        e = np.clip(profile - np.polyval(np.polyfit(t[~near], profile[~near], 1), t), 0, None)[near]
        if e.sum() <= 1e-6:
            return None
        out += [(e * t[near]).sum() / e.sum(), e.sum()]
    return out[0], out[2], out[1]


def test_measured_lines_equal_dense_image(spark):
    rng = np.random.default_rng(11)
    image = np.where(rng.uniform(size=(50, 50)) < 0.4, rng.uniform(0, 3, (50, 50)), 0.0)
    image[20:24, 30:33] += 50
    image[33:, :17] = 0
    pix = [(1, j, i, float(v)) for (j, i), v in np.ndenumerate(image) if v] + [(2, 3, 3, 1.0), (1, 21, 31, 25.0), (1, 21, 31, -25.0)]
    places = [(k, 1, float(rng.uniform(-3, 53)), float(rng.uniform(-3, 53))) for k in range(300)] + [(300, 1, 31.2, 21.5), (301, 1, 8.0, 41.0), (302, 2, 25.0, 25.0), (303, 9, 25.0, 25.0), (304, 1, None, 3.0)]
    at = spark.createDataFrame(places, "id int, sca int, x double, y double")
    df = spark.createDataFrame(pix, "sca int, y int, x int, value_a double")
    got = {r["id"]: (r["along"], r["across"], r["flux"]) for r in pixels.measure(pixels.profiles(at, df, 50, 8, 3), 8, 4).collect()}
    want = {k: brute_line(image, x, y, 8, 3, 4) for k, s, x, y in places if s == 1 and x is not None}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(want) and len(want) > 50 and 300 in got
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert pixels.measure(pixels.profiles(at, df.limit(0), 50, 8, 3), 8, 4).collect() == []
