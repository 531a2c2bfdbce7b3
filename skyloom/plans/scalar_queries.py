"""Queries for column builders: photometry, geometry, frames, traces, cells, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import scalar as S
from skyloom.plans.registry import query

MAG = "round(CASE WHEN {0} > 0 THEN -2.5 * log10({0}) ELSE 'NaN'::DOUBLE END, 6)"


def r(c, n=6):
    return F.round(c, n)


@query("mag_maggies", "SELECT catalog_index, round(pow(10, -0.4 * mag) * 1e9, 6) AS flux, round(-2.5 * log10(pow(10, -0.4 * mag)), 6) AS mag_back FROM {sources}")
def mag_maggies(t):
    return t("sources").select("catalog_index", r(S.mag_to_flux("mag") * 1e9).alias("flux"), r(S.flux_to_mag(S.mag_to_flux("mag"))).alias("mag_back"))


@query("fnu_to_flam", "SELECT catalog_index, round(flux_scale * 2.99792458e18 / pow(9000 + 200.0 * sed_index, 2) / 1e9, 6) AS flam FROM {sources}")
def fnu_to_flam(t):
    return t("sources").select("catalog_index", r(S.fnu_to_flam("flux_scale", 9000 + 200.0 * F.col("sed_index")) / 1e9).alias("flam"))


@query("flat_ab_flam", "SELECT catalog_index, round(3.631e-20 * 2.99792458e18 / pow(9000 + 200.0 * sed_index, 2) * pow(10, -0.4 * mag) * 1e18, 6) AS flam FROM {sources}")
def flat_ab_flam(t):
    return t("sources").select("catalog_index", r(S.flat_ab_flam(9000 + 200.0 * F.col("sed_index"), "mag") * 1e18).alias("flam"))


HAV = "degrees(2 * asin(sqrt(least(1.0, pow(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin(radians({r2} - {r1}) / 2), 2)))))"


@query("haversine", f"SELECT catalog_index, round({HAV.format(r1='ra', d1='dec', r2='10.0', d2='0.0')}, 6) AS sep FROM {{sources}}")
def haversine(t):
    return t("sources").select("catalog_index", r(S.haversine("ra", "dec", 10.0, 0.0)).alias("sep"))


DEPTH = "(cos(radians(dec0)) * cos(radians(dec)) * cos(radians(ra - ra0)) + sin(radians(dec0)) * sin(radians(dec)))"
XI = f"degrees(cos(radians(dec)) * sin(radians(ra - ra0)) / {DEPTH})"
ETA = f"degrees((cos(radians(dec0)) * sin(radians(dec)) - sin(radians(dec0)) * cos(radians(dec)) * cos(radians(ra - ra0))) / {DEPTH})"
PAIRS = "FROM {sources} s JOIN {pointings} p ON s.catalog_index % 25 = p.pointing_id"


def pairs(t):
    return t("sources").join(F.broadcast(t("pointings")), F.expr("catalog_index % 25 = pointing_id"))


@query("tangent_offsets", f"SELECT catalog_index, pointing_id, round({XI}, 6) AS xi, round({ETA}, 6) AS eta {PAIRS}")
def tangent_offsets(t):
    df = pairs(t)
    S.require_double(df, "ra", "dec", "ra0", "dec0")
    xi, eta = S.tangent_offsets("ra", "dec", "ra0", "dec0")
    return df.select("catalog_index", "pointing_id", r(xi).alias("xi"), r(eta).alias("eta"))


@query("flat_sky_offsets", f"SELECT catalog_index, pointing_id, round((ra - ra0) * cos(radians(dec0)), 6) AS dx, round(dec - dec0, 6) AS dy {PAIRS}")
def flat_sky_offsets(t):
    dx, dy = S.flat_sky_offsets("ra", "dec", "ra0", "dec0")
    return pairs(t).select("catalog_index", "pointing_id", r(dx).alias("dx"), r(dy).alias("dy"))


ROT_X, ROT_Y = "-(cos(radians(pa + 120)) * {0} - sin(radians(pa + 120)) * {1})", "-(sin(radians(pa + 120)) * {0} + cos(radians(pa + 120)) * {1})"
FPA_SQL = f"SELECT *, {ROT_X.format('xi', 'eta')} AS xf, {ROT_Y.format('xi', 'eta')} AS yf FROM (SELECT *, {XI} AS xi, {ETA} AS eta {PAIRS})"


def focal(t):
    xi, eta = S.tangent_offsets("ra", "dec", "ra0", "dec0")
    df = pairs(t).withColumns({"xi": xi, "eta": eta})
    xf, yf = S.pa_rotation("xi", "eta", "pa")
    return df.withColumns({"xf": xf, "yf": yf})


@query("pa_rotation", f"SELECT catalog_index, round(xf, 6) AS xf, round(yf, 6) AS yf FROM ({FPA_SQL})")
def pa_rotation(t):
    return focal(t).select("catalog_index", r(F.col("xf")).alias("xf"), r(F.col("yf")).alias("yf"))


ON_SCA = "FROM {manifest} m JOIN {calibration} c USING (sca, ord)"


def on_sca(t):
    return t("manifest").join(F.broadcast(t("calibration")), ["sca", "ord"])


def frame(name, fn, a, b, sql_x, sql_y, n=6):
    def build(t):
        x, y = fn(F.expr(a), F.expr(b))
        return on_sca(t).select("catalog_index", r(x, n).alias("x"), r(y, n).alias("y"))

    query(name, f"SELECT catalog_index, round({sql_x}, {n}) AS x, round({sql_y}, {n}) AS y {ON_SCA}")(build)


MM_X, MM_Y = "(xcen - (xsca - crpix) / plate_scale)", "(ycen + (ysca - crpix) / plate_scale)"
K = "(plate_scale * pixel_scale / 3600)"
frame("sca_mpa", S.sca_mpa, "xsca", "ysca", MM_X, MM_Y)
frame("mpa_sca", S.mpa_sca, "xsca / 40", "ysca / 40", "crpix - (xsca / 40 - xcen) * plate_scale", "crpix + (ysca / 40 - ycen) * plate_scale", 4)
frame("mpa_fpa", S.mpa_fpa, "xsca / 40", "ysca / 40", f"xsca / 40 * {K}", f"ysca / 40 * {K}")
frame("fpa_mpa", S.fpa_mpa, "xsca / 9000", "ysca / 9000", f"xsca / 9000 / {K}", f"ysca / 9000 / {K}")
frame("sca_fpa", S.sca_fpa, "xsca", "ysca", f"{MM_X} * {K}", f"{MM_Y} * {K}")
frame("fpa_sca", S.fpa_sca, "xsca / 9000", "ysca / 9000", f"crpix - (xsca / 9000 / {K} - xcen) * plate_scale", f"crpix + (ysca / 9000 / {K} - ycen) * plate_scale", 4)


@query("wl_transform", f"SELECT catalog_index, round(w, 6) AS w, round(CASE kind WHEN 'log' THEN wl_ref * pow(10, w) ELSE w + wl_ref END, 6) AS back FROM (SELECT *, CASE kind WHEN 'log' THEN log10((0.9 + mag / 28) / wl_ref) ELSE 0.9 + mag / 28 - wl_ref END AS w {ON_SCA})")
def wl_transform(t):
    df = on_sca(t).withColumn("w", S.wl_transform(0.9 + F.col("mag") / 28, "wl_ref", "kind"))
    return df.select("catalog_index", r(F.col("w")).alias("w"), r(S.wl_inverse("w", "wl_ref", "kind")).alias("back"))


POLY_X, POLY_Y = "(x00 + x01 * {y} + x10 * {x} + x11 * {x} * {y})", "(y00 + y01 * {y} + y10 * {x} + y11 * {x} * {y})"


def nested(t):
    return t("manifest").select("catalog_index", "sca", "ord", "type", "mag", "flux_scale", (F.col("xsca") / 9000).alias("xf"), (F.col("ysca") / 9000).alias("yf")).join(F.broadcast(S.nested_calibration(t("calibration"))), ["sca", "ord"])


NESTED = f"(SELECT *, xsca / 9000 AS xf, ysca / 9000 AS yf {ON_SCA})"


@query("poly2d", f"SELECT catalog_index, round({POLY_X.format(x='xf', y='yf')}, 6) AS x, round({POLY_Y.format(x='xf', y='yf')}, 6) AS y FROM {NESTED}")
def poly2d(t):
    return nested(t).select("catalog_index", r(S.poly2d("xf", "yf", F.col("x_ij"))).alias("x"), r(S.poly2d("xf", "yf", F.col("y_ij"))).alias("y"))


@query("trace_coeffs", f"SELECT catalog_index, round(c1 + cx * xf, 9) AS c1, round(d1 + dx * xf, 9) AS d1 FROM {NESTED}")
def trace_coeffs(t):
    return nested(t).select("catalog_index", r(S.trace_coeffs("xf", "yf", F.col("c_ijk"))[1], 9).alias("c1"), r(S.trace_coeffs("xf", "yf", F.col("d_ijk"))[1], 9).alias("d1"))


def traced_sql(rows: str, wl: str, x: str = "xf", y: str = "yf") -> str:
    """Rows with px, py (pixels) of light of a wavelength in micron; formulas written out, not nested."""
    t = f"CASE kind WHEN 'log' THEN log10(({wl}) / wl_ref) ELSE ({wl}) - wl_ref END"
    a = f"SELECT *, d0 + (d1 + dx * {x}) * ({t}) + d2 * ({t}) * ({t}) AS along_ FROM {rows}"
    b = f"SELECT *, {POLY_X.format(x=x, y=y)} + c0 + (c1 + cx * {x}) * along_ + c2 * along_ * along_ AS mx, {POLY_Y.format(x=x, y=y)} + along_ AS my FROM ({a})"
    return f"(SELECT *, crpix - (mx - xcen) * plate_scale AS px, crpix + (my - ycen) * plate_scale AS py FROM ({b}))"


@query("trace_position", f"SELECT catalog_index, round(px, 4) AS px, round(py, 4) AS py FROM {traced_sql(NESTED, '0.9 + mag / 28')}")
def trace_position(t):
    px, py = S.trace_position("xf", "yf", 0.9 + F.col("mag") / 28)
    return nested(t).select("catalog_index", r(px, 4).alias("px"), r(py, 4).alias("py"))


WAVES = "(SELECT * FROM " + NESTED + " , (VALUES (0.9), (1.1), (1.3), (1.5), (1.7), (1.9)) AS w(wl))"


@query("trace_table", f"SELECT catalog_index, wl::DOUBLE AS wl, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my, round(px, 4) AS px, round(py, 4) AS py, round(mx * {K}, 6) + 0.0 AS fx, round(my * {K}, 6) + 0.0 AS fy FROM {traced_sql(WAVES, 'wl')}")
def trace_table(t):
    df = nested(t).withColumn("wl", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.round(0.9 + 0.2 * i, 1))))
    mx, my = S.trace_mpa("xf", "yf", "wl")
    df = df.withColumns({"mx": mx, "my": my})
    px, py = S.mpa_sca("mx", "my")
    fx, fy = S.mpa_fpa("mx", "my")
    return df.select("catalog_index", "wl", r(F.col("mx")).alias("mx"), r(F.col("my")).alias("my"), r(px, 4).alias("px"), r(py, 4).alias("py"), r(fx).alias("fx"), r(fy).alias("fy"))


def step_sql(dx: str, dy: str, wl: str) -> str:
    return traced_sql(f"(SELECT * REPLACE (xf + {dx} AS xf, yf + {dy} AS yf) FROM {NESTED})", wl)


JAC = " JOIN ".join(f"{step_sql(dx, dy, '1.4')} {n}{'' if n == 'a' else ' USING (catalog_index)'}" for n, dx, dy in (("a", "1e-4", "0"), ("b", "-1e-4", "0"), ("c", "0", "1e-4"), ("d", "0", "-1e-4")))


@query("trace_jacobian", f"SELECT catalog_index, round((a.px - b.px) / 2e-4, 3) AS xx, round((c.px - d.px) / 2e-4, 3) AS xy, round((a.py - b.py) / 2e-4, 3) AS yx, round((c.py - d.py) / 2e-4, 3) AS yy FROM {JAC}")
def trace_jacobian(t):
    """Central differences of the position with respect to the focal-plane position."""
    h = 1e-4
    at = lambda dx, dy: S.trace_position(F.col("xf") + dx, F.col("yf") + dy, F.lit(1.4))
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = at(h, 0.0), at(-h, 0.0), at(0.0, h), at(0.0, -h)
    return nested(t).select("catalog_index", *(r(v / (2 * h), 3).alias(n) for n, v in (("xx", ax - bx), ("xy", cx - dx), ("yx", ay - by), ("yy", cy - dy))))


AXES = f"{traced_sql(NESTED, '1.4 + 1e-3')} a JOIN {traced_sql(NESTED, '1.4')} b USING (catalog_index)"


@query("dispersion_axes", f"SELECT catalog_index, round(ux / n, 6) AS ux, round(uy / n, 6) AS uy, round(-uy / n, 6) AS vx, round(ux / n, 6) AS vy FROM (SELECT *, sqrt(ux * ux + uy * uy) AS n FROM (SELECT catalog_index, a.px - b.px AS ux, a.py - b.py AS uy FROM {AXES}))")
def dispersion_axes(t):
    """Unit vectors along and across the dispersion."""
    (ax, ay), (bx, by) = S.trace_position("xf", "yf", F.lit(1.4 + 1e-3)), S.trace_position("xf", "yf", F.lit(1.4))
    df = nested(t).select("catalog_index", (ax - bx).alias("ux"), (ay - by).alias("uy")).withColumn("n", F.hypot("ux", "uy"))
    return df.select("catalog_index", r(F.col("ux") / F.col("n")).alias("ux"), r(F.col("uy") / F.col("n")).alias("uy"), r(-F.col("uy") / F.col("n")).alias("vx"), r(F.col("ux") / F.col("n")).alias("vy"))


@query("uniq_pack", "SELECT catalog_index, 4 * 16384 + pix % 16384 AS uniq, 4 * pow(4, pix % 8)::BIGINT + pix % 4 AS mixed FROM {cells}")
def uniq_pack(t):
    return t("cells").select("catalog_index", S.uniq_pack(7, F.col("pix") % 16384).alias("uniq"), S.uniq_pack((F.col("pix") % 8).cast("int"), F.col("pix") % 4).alias("mixed"))


@query("uniq_unpack", "SELECT catalog_index, (pix % 13)::INT AS k, (pix % 4)::BIGINT AS p FROM {cells}")
def uniq_unpack(t):
    df = t("cells").withColumn("u", S.uniq_pack((F.col("pix") % 13).cast("int"), F.col("pix") % 4))
    return df.select("catalog_index", S.uniq_order("u").alias("k"), S.uniq_pix("u").alias("p"))


@query("cell_parent", "SELECT catalog_index, pix // 4 AS p1, pix // 64 AS p3 FROM {cells}")
def cell_parent(t):
    return t("cells").select("catalog_index", S.cell_parent("pix", 1).alias("p1"), S.cell_parent("pix", 3).alias("p3"))


def sky_cell_sql(ra: str, dec: str, order: int) -> str:
    """The cell from its definition: face, then the bits of the position on it, one by one."""
    n = 2**order
    z, tt = f"sin(radians({dec}))", f"((({ra}) % 360 + 360) % 360 / 90)"
    up, down = f"floor({n} * (0.5 + {tt}) - {n} * {z} * 0.75)::BIGINT", f"floor({n} * (0.5 + {tt}) + {n} * {z} * 0.75)::BIGINT"
    part = f"SELECT *, {z} AS z, {tt} AS tt, {up} AS up, {down} AS down FROM {{rows}}"
    polar = f"SELECT *, least(floor(tt), 3)::BIGINT AS quarter, abs(z) <= 2 / 3.0 AS belt, {n} * sqrt(3 * (1 - abs(z))) AS reach FROM ({part})"
    cap = f"SELECT *, least(floor((tt - quarter) * reach), {n - 1})::BIGINT AS jp, least(floor((1 - tt + quarter) * reach), {n - 1})::BIGINT AS jm FROM ({polar})"
    face = f"CASE WHEN belt THEN CASE WHEN up // {n} = down // {n} THEN (up // {n}) % 4 + 4 WHEN up // {n} < down // {n} THEN up // {n} ELSE down // {n} + 8 END WHEN z >= 0 THEN quarter ELSE quarter + 8 END"
    x = f"CASE WHEN belt THEN down % {n} WHEN z >= 0 THEN {n - 1} - jm ELSE jp END"
    y = f"CASE WHEN belt THEN {n - 1} - up % {n} WHEN z >= 0 THEN {n - 1} - jp ELSE jm END"
    bits = " + ".join(f"(({a} >> {i}) & 1) * {1 << (2 * i + k)}" for i in range(order) for k, a in ((0, "cx"), (1, "cy")))
    return f"SELECT catalog_index, face * {4**order} + {bits} AS cell FROM (SELECT *, {face} AS face, {x} AS cx, {y} AS cy FROM ({cap}))"


CELL_ROWS = "(SELECT catalog_index, ra, dec, ra * 32 AS ra_wide, dec * 89 AS dec_all FROM {sources})"


@query("sky_cell", f"SELECT a.catalog_index, a.cell::BIGINT AS cell, b.cell::BIGINT AS wide FROM ({sky_cell_sql('ra', 'dec', 12).replace('{rows}', CELL_ROWS)}) a JOIN ({sky_cell_sql('ra_wide', 'dec_all', 6).replace('{rows}', CELL_ROWS)}) b USING (catalog_index)")
def sky_cell(t):
    s = t("sources").withColumn("dec_all", F.col("dec") * 89)
    return s.select("catalog_index", S.sky_cell("ra", "dec", 12).alias("cell"), S.sky_cell(F.col("ra") * 32, "dec_all", 6).alias("wide"))


@query("radius_to_pixels", "SELECT catalog_index, round(half_light_radius / 0.11 * 5, 6) AS px FROM {sources}")
def radius_to_pixels(t):
    return t("sources").select("catalog_index", r(S.radius_to_pixels("half_light_radius", 0.11, 5)).alias("px"))


@query("sky_pa_theta", f"SELECT catalog_index, round(radians(z_obs * 60 - pa + 150), 6) AS theta {PAIRS}")
def sky_pa_theta(t):
    return pairs(t).select("catalog_index", r(S.sky_pa_theta(F.col("z_obs") * 60, "pa")).alias("theta"))


@query("center_to_corner", "SELECT catalog_index, round(xsca - (sca * 10 - 1) / 2.0 * 0.5, 6) AS x0 FROM {manifest}")
def center_to_corner(t):
    return t("manifest").select("catalog_index", r(S.center_to_corner("xsca", F.col("sca") * 10, 0.5)).alias("x0"))


@query("observed_lines", "SELECT catalog_index, line_id, round(center_a * (1 + z_obs), 4) AS observed FROM {sources}, {lines} WHERE center_a * (1 + z_obs) BETWEEN 10000 AND 19300")
def observed_lines(t):
    df = t("sources").crossJoin(F.broadcast(t("lines"))).withColumn("observed", F.col("center_a") * (1 + F.col("z_obs")))
    return df.filter(F.col("observed").between(10000, 19300)).select("catalog_index", "line_id", r(F.col("observed"), 4).alias("observed"))


@query("template_mod", "SELECT catalog_index, (catalog_index % 58)::INT AS template FROM {sources}")
def template_mod(t):
    return t("sources").select("catalog_index", F.pmod(F.col("catalog_index"), F.lit(58)).cast("int").alias("template"))


@query("asinh_stretch", "WITH q AS (SELECT sca, quantile_cont(value_a, 0.01) AS lo, quantile_cont(value_a, 0.99) AS hi FROM {pixels} GROUP BY sca) SELECT sca, y, x, round(asinh(10 * greatest(0, least(1, (value_a - lo) / (hi - lo)))) / asinh(10.0), 6) AS v FROM {pixels} JOIN q USING (sca)")
def asinh_stretch(t):
    p = t("pixels")
    lim = p.groupBy("sca").agg(F.percentile("value_a", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value_a") - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0])))
    v = F.when(F.isnan(u), F.lit(0.0)).otherwise(F.asinh(10 * u) / F.asinh(F.lit(10.0)))
    return p.join(F.broadcast(lim), "sca").select("sca", "y", "x", r(v).alias("v"))


@query("pointing_name", "SELECT catalog_index, 'pointing_' || lpad(sca::VARCHAR, 3, '0') || '.' || lpad(src_group::VARCHAR, 3, '0') AS name FROM {manifest}")
def pointing_name(t):
    return t("manifest").select("catalog_index", S.pointing_name("pointing", "sca", "src_group").alias("name"))


@query("pointing_key", "SELECT catalog_index, xor(('0x' || substr(sha256('tag_' || catalog_index), 1, 8))::BIGINT, 12345) AS key FROM {sources}")
def pointing_key(t):
    return t("sources").select("catalog_index", S.pointing_key(F.concat(F.lit("tag_"), F.col("catalog_index").cast("string")), 12345).alias("key"))


APPEAR = "SELECT catalog_index, string_agg('SCA' || lpad(sca::VARCHAR, 2, '0') || ':' || ord || ':' || round(xsca)::BIGINT || ',' || round(ysca)::BIGINT, ';' ORDER BY sca, ord, xsca) AS appearances FROM {placements} GROUP BY 1"


def appearances(t):
    item = F.struct("sca", "ord", "xsca", "ysca")
    whole = lambda v: F.round(v).cast("long").cast("string")
    text = lambda m: F.concat(F.lit("SCA"), F.lpad(m["sca"].cast("string"), 2, "0"), F.lit(":"), m["ord"], F.lit(":"), whole(m["xsca"]), F.lit(","), whole(m["ysca"]))
    return t("placements").groupBy("catalog_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), text), ";").alias("appearances"))


@query("appearance_string", APPEAR)
def appearance_string(t):
    """All places of a source as one string, in order."""
    return appearances(t)


@query("parse_appearance", "SELECT catalog_index, nullif(regexp_extract(appearances, 'SCA03:1:(-?[0-9]+),(-?[0-9]+)', 1), '')::BIGINT AS x, nullif(regexp_extract(appearances, 'SCA03:1:(-?[0-9]+),(-?[0-9]+)', 2), '')::BIGINT AS y FROM (" + APPEAR + ") WHERE regexp_matches(appearances, 'SCA03:1:')")
def parse_appearance(t):
    """Position for one detector and order, recovered from the strings that have it."""
    part = lambda g: F.nullif(F.regexp_extract("appearances", "SCA03:1:(-?[0-9]+),(-?[0-9]+)", g), F.lit("")).cast("long")
    return appearances(t).filter(F.contains("appearances", F.lit("SCA03:1:"))).select("catalog_index", part(1).alias("x"), part(2).alias("y"))


@query("sim_key", "SELECT catalog_index, 'sim_' || lpad(sim::VARCHAR, 3, '0') AS key, 'sim_' || type AS named FROM {sources}")
def sim_key(t):
    return t("sources").select("catalog_index", S.sim_key("sim").alias("key"), S.sim_key("type").alias("named"))


@query("value_precedence", "SELECT catalog_index, coalesce(CASE WHEN catalog_index % 3 = 0 THEN mag END, CASE WHEN catalog_index % 5 < 3 THEN z_obs END, 1.5) AS value, coalesce(catalog_index % 3 = 0 AND catalog_index % 5 < 3 AND mag <> z_obs, false) AS contradicts FROM {sources}")
def value_precedence(t):
    """Explicit over header over default; flagged where explicit and header differ."""
    explicit, header = F.when(F.col("catalog_index") % 3 == 0, F.col("mag")), F.when(F.col("catalog_index") % 5 < 3, F.col("z_obs"))
    return t("sources").select("catalog_index", F.coalesce(explicit, header, F.lit(1.5)).alias("value"), F.coalesce(explicit != header, F.lit(False)).alias("contradicts"))


@query("line_spectrum", "SELECT curve, i, round(sens + (SELECT sum(sens * amp_rel * exp(-0.5 * pow((wavelength - center_a) / (fwhm_a * 20 / (2 * sqrt(2 * ln(2)))), 2))) FROM {lines}), 6) AS total FROM {curves}")
def line_spectrum(t):
    """The lines, twenty times as wide so that the grid resolves them, on each spectrum as continuum. The line list is a short constant."""
    lines = t("lines").agg(F.sort_array(F.collect_list(F.struct("center_a", (F.col("fwhm_a") * 20).alias("fwhm_a"), "amp_rel"))).alias("lines"))
    return t("curves").crossJoin(F.broadcast(lines)).select("curve", "i", r(S.line_spectrum(F.col("wavelength"), F.col("lines"), F.col("sens"))).alias("total"))


@query("line_catalog", "SELECT catalog_index, ra, dec, 'SER' AS type, 1.0::DOUBLE AS flux_scale, 0 AS sim, 0 AS sed_index, round(mag, 4) AS mag, 1.0::DOUBLE AS n, 0.1::DOUBLE AS half_light_radius FROM {sources} WHERE type = 'PSF' AND mag <= 20.0001")
def line_catalog(t):
    """Selected stars re-issued as galaxies that share one spectrum."""
    s = t("sources").filter((F.col("type") == "PSF") & (F.col("mag") <= 20.0001))
    return s.select("catalog_index", "ra", "dec", F.lit("SER").alias("type"), F.lit(1.0).alias("flux_scale"), F.lit(0).alias("sim"), F.lit(0).alias("sed_index"), r(F.col("mag"), 4).alias("mag"), F.lit(1.0).alias("n"), F.lit(0.1).alias("half_light_radius"))


@query("sloped_taper", "SELECT curve, i, round(sens * (1 + 0.5 * (i / 63.0 - 0.5)) * CASE WHEN i < 8 THEN 0.5 * (1 - cos(pi() * i / 8)) WHEN i > 55 THEN 0.5 * (1 - cos(pi() * (63 - i) / 8)) ELSE 1 END, 6) AS v FROM {curves}")
def sloped_taper(t):
    """Linear slope times a cosine taper over eight samples at both ends of each spectrum."""
    i = F.col("i")
    edge = lambda k: 0.5 * (1 - F.cos(F.pi() * k / 8))
    taper = F.when(i < 8, edge(i)).when(i > 55, edge(63 - i)).otherwise(F.lit(1.0))
    return t("curves").select("curve", "i", r(F.col("sens") * (1 + 0.5 * (i / 63.0 - 0.5)) * taper).alias("v"))
