"""Queries for validation, comparison, windows, samples, set operations, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import scalar as S
from skyloom.operators import quality as Q
from skyloom.operators import cells, sky, spectra
from skyloom.operators.quantiles import ranks
from skyloom.plans.join_queries import COARSEST, FINEST, LINE_ROWS, ROW_BYTES, TARGET, laid_out
from skyloom.plans.registry import query
from skyloom.plans.scalar_queries import NESTED, nested, r, sky_cell_sql, traced_sql
from skyloom.sources import readers

REQUIRED = ("ra", "dec", "type", "n", "half_light_radius", "pa", "ba", "sed_index", "flux_scale", "sim")
#: Conditions on rows of the catalog, with the number of its partition's spectra (``stored``), templates being those of stars.
ROW_CHECKS = [
    ("bad_type", "type NOT IN ('PSF', 'SER')"), ("nonfinite", "NOT (abs(ra) < 1e308 AND abs(dec) < 1e308 AND abs(flux_scale) < 1e308)"), ("dec_range", "abs(dec) > 90"),
    ("star_index", "type = 'PSF' AND sed_index >= 20"), ("no_partition", "type = 'SER' AND stored IS NULL"), ("index_range", "type = 'SER' AND (sed_index < 0 OR sed_index >= stored)"),
    ("star_with_radius", "type = 'PSF' AND half_light_radius <> 0"), ("galaxy_without_radius", "type = 'SER' AND half_light_radius <= 0"), ("large_radius", "type = 'SER' AND half_light_radius > 0.85"),
]
WIDTH = ("width", "len_ <> n_wl")
SED_CHECKS = [WIDTH, ("nonfinite_sed", "bad > 0"), ("empty_sed", "positive = 0")]
BANDS = {"GRISM": (10000.0, 19300.0), "PRISM": (7500.0, 18500.0)}
PARTED = "(SELECT s.*, p.stored FROM {sources} s LEFT JOIN (SELECT sim, count(*) AS stored FROM {spectra} GROUP BY sim) p ON s.sim = p.sim)"
SEDS = "(SELECT len(embedding) AS len_, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) AS bad, len(list_filter(embedding, lambda x: x > 0)) AS positive, (SELECT count(*) FROM {grid}) AS n_wl FROM {spectra})"
COUNT = lambda rows, checks: " UNION ALL ".join(f"SELECT '{n}' AS issue, count(*) FILTER ({c}) AS n FROM {rows}" for n, c in checks)
VALIDATE = f"{COUNT(PARTED, ROW_CHECKS)} UNION ALL {COUNT(SEDS, SED_CHECKS)} UNION ALL SELECT 'missing_columns', 3 UNION ALL SELECT 'spacing', count(*) FROM (SELECT wavelength - lag(wavelength) OVER (ORDER BY wavelength) AS d FROM {{grid}}) WHERE abs(d / 200 - 1) > 1e-4 UNION ALL " + " UNION ALL ".join(f"SELECT 'coverage_{b}', (min(wavelength) > {lo} OR max(wavelength) < {hi})::BIGINT FROM {{grid}}" for b, (lo, hi) in BANDS.items())


def parted(t):
    """The catalog with the number of spectra in each row's partition."""
    sizes = t("spectra").groupBy("sim").agg(F.count("*").alias("stored"))
    return t("sources").join(F.broadcast(sizes), "sim", "left")


@query("catalog_validate", f"SELECT issue, n::BIGINT AS n FROM ({VALIDATE})")
def catalog_validate(t):
    """Catalog, spectra and wavelength grid against what a run needs: rows that fail each check; for the grid and the columns, whether or how many."""
    n_wl = t("grid").agg(F.count("*").alias("n_wl"))
    off = F.filter("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    seds = t("spectra").crossJoin(F.broadcast(n_wl)).select("n_wl", F.size("embedding").alias("len_"), F.size(off).alias("bad"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))
    missing = sum(c not in t("sources").columns for c in REQUIRED)
    ends = t("grid").agg(F.min("wavelength").alias("lo"), F.max("wavelength").alias("hi"), F.sort_array(F.collect_list("wavelength")).alias("all"))
    steps = F.transform(F.slice("all", F.lit(2), F.size("all") - 1), lambda x, i: x - F.col("all")[i])
    bad = F.size(F.filter(steps, lambda d: F.abs(d / F.element_at(steps, 1) - 1) > 1e-4)).cast("long")
    grid = [("missing_columns", F.lit(missing).cast("long")), ("spacing", bad)] + [(f"coverage_{b}", ((F.col("lo") > lo) | (F.col("hi") < hi)).cast("long")) for b, (lo, hi) in BANDS.items()]
    whole = ends.select(F.explode(F.array(*(F.struct(F.lit(n).alias("issue"), c.alias("n")) for n, c in grid))).alias("x")).select("x.*")
    return Q.count_checks(parted(t), ROW_CHECKS).unionByName(Q.count_checks(seds, SED_CHECKS)).unionByName(whole)


CONSIST = [
    ("bad_type", "type NOT IN ('PSF', 'SER')"), ("star_sim", "type = 'PSF' AND sim <> 0"), ("star_scale", "type = 'PSF' AND abs(flux_scale / pow(10, -0.4 * mag) - 1) > 1e-5"),
    ("star_radius", "type = 'PSF' AND half_light_radius <> 0"), ("star_index", "type = 'PSF' AND sed_index >= 20"), ("galaxy_sim", "type = 'SER' AND sim <= 0"),
    ("galaxy_scale", "type = 'SER' AND flux_scale <> 1"), ("galaxy_partition", "type = 'SER' AND stored IS NULL"), ("galaxy_index", "type = 'SER' AND (sed_index < 0 OR sed_index >= stored)"),
    ("galaxy_radius", "type = 'SER' AND NOT half_light_radius > 0"),
]


@query("catalog_consistency", f"SELECT * FROM ({COUNT(PARTED, CONSIST)})")
def catalog_consistency(t):
    """Invariants of stars and galaxies, index ranges against the partitions' real sizes."""
    return Q.count_checks(parted(t), CONSIST)


@query("element_compat", "WITH o AS (SELECT sca, count(DISTINCT ord) AS orders FROM {calibration} GROUP BY sca) SELECT pointing_id, bandpass, orders >= CASE bandpass WHEN 'PRISM' THEN 1 ELSE 3 END AS enough, abs(wl_ref - CASE bandpass WHEN 'PRISM' THEN 1.2 ELSE 1.55 END) <= 0.005 AS band_ok FROM {visits} JOIN o USING (sca)")
def element_compat(t):
    """Element of each pointing against its detector's calibration: orders present, reference wavelength within 0.005 micron."""
    orders = t("calibration").groupBy("sca").agg(F.count_distinct("ord").alias("orders"))
    prism = F.col("bandpass") == "PRISM"
    e = t("visits").join(sky.small(orders), "sca")
    return e.select("pointing_id", "bandpass", (F.col("orders") >= F.when(prism, 1).otherwise(3)).alias("enough"), (F.abs(F.col("wl_ref") - F.when(prism, 1.2).otherwise(1.55)) <= 0.005).alias("band_ok"))


COLS = ("ra", "dec", "type", "mag", "sim")


@query("catalog_diff", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) AS differ FROM {{sources}} a JOIN (SELECT * REPLACE (CASE WHEN catalog_index % 50 = 0 THEN mag + 1 ELSE mag END AS mag, CASE WHEN catalog_index % 90 = 0 THEN NULL ELSE sim END AS sim) FROM {{sources}}) b USING (catalog_index)" for c in COLS) + ")")
def catalog_diff(t):
    a = t("sources").select("catalog_index", *COLS)
    b = a.withColumns({"mag": F.when(F.col("catalog_index") % 50 == 0, F.col("mag") + 1).otherwise(F.col("mag")), "sim": F.when(F.col("catalog_index") % 90 != 0, F.col("sim"))})
    return Q.column_differences(a, b, "catalog_index", COLS)


@query("spectra_diff", "SELECT vec_id, round(max(abs(b - a) / a), 6) AS worst FROM (SELECT vec_id, i, a, a * (1 + (vec_id % 5) / 1000.0) + i / 1e6 AS b, max(a) OVER (PARTITION BY vec_id) AS peak FROM (SELECT vec_id, unnest(range(0, 64)) AS i, abs(unnest(embedding)::DOUBLE) AS a FROM {spectra})) WHERE a > 0.01 * peak GROUP BY vec_id")
def spectra_diff(t):
    df = t("spectra").withColumn("a", spectra.flux_array("embedding")).withColumn("peak", F.array_max("a"))
    pairs = F.transform("a", lambda a, i: F.when(a > 0.01 * F.col("peak"), F.abs(a * (1 + F.col("vec_id") % 5 / 1000.0) + i / 1e6 - a) / a))
    return df.select("vec_id", r(F.array_max(pairs)).alias("worst"))


#: Galaxies with a spectrum, their cells at the finest order of the layout, and the layout's cover.
LAID = "(SELECT catalog_index, ra, dec FROM {sources} JOIN {spectra} USING (sim, sed_index) WHERE type = 'SER')"
FINE = f"fine AS MATERIALIZED ({sky_cell_sql('ra', 'dec', FINEST).replace('{rows}', LAID)})"
COUNTS = "counts AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {o} AS ord, cell // {4 ** (FINEST - o)} AS cell, count(*) AS planned, count(*) FILTER (catalog_index % 7 = 3) AS lost FROM fine GROUP BY 2" for o in range(COARSEST, FINEST + 1)) + ")"
PLANNED = f"SELECT 4 * pow(4, c.ord)::BIGINT + c.cell::BIGINT AS hp_uniq, c.planned, CASE WHEN hp_uniq % 13 = 7 AND c.lost < c.planned THEN c.lost ELSE 0 END AS lost FROM counts c LEFT JOIN counts p ON p.ord = c.ord - 1 AND p.cell = c.cell // 4 WHERE (c.planned * {ROW_BYTES} <= {TARGET} OR c.ord = {FINEST}) AND (c.ord = {COARSEST} OR p.planned * {ROW_BYTES} > {TARGET})"


@query("repartition_verify", f"WITH {FINE}, {COUNTS}, p AS ({PLANNED}) SELECT hp_uniq, planned, planned - lost AS stored, planned AS noted, lost = 0 AND hp_uniq % 13 <> 5 AS same, same AS ok FROM p")
def repartition_verify(t):
    """A written layout with some cells damaged on purpose (rows lost, spectra turned round): per cell, rows planned, stored and noted, and whether the contents are the original's."""
    spark, path, plan, _, rows = laid_out(t)
    hurt = cells.stored(spark, path).filter("hp_uniq % 13 = 5 or (hp_uniq % 13 = 7 and catalog_index % 7 <> 3)")
    cells.replace_cells(readers.kept(hurt.withColumn("flux", F.when(F.col("hp_uniq") % 13 == 5, F.reverse("flux")).otherwise(F.col("flux")))), path)
    return cells.verify(spark, path, plan, rows, "catalog_index")


OFFS = f"(SELECT a.catalog_index, a.wl, a.px - b.px AS dx, a.py - b.py AS dy FROM {traced_sql('(SELECT * FROM ' + NESTED + ', (VALUES (1.0), (1.3), (1.6)) w(wl))', 'wl')} a JOIN {traced_sql('(SELECT * REPLACE (d1 * 1.001 AS d1) FROM ' + NESTED + ', (VALUES (1.0), (1.3), (1.6)) w(wl))', 'wl')} b USING (catalog_index, wl))"


def offsets(t):
    """Differences between the traces of two calibrations, at three wavelengths."""
    other = t("calibration").withColumn("d1", F.col("d1") * 1.001)
    df = nested(t).withColumn("wl", F.explode(F.array(F.lit(1.0), F.lit(1.3), F.lit(1.6))))
    px, py = S.trace_position("xf", "yf", "wl")
    a = df.select("catalog_index", "sca", "ord", "xf", "yf", "wl", px.alias("px"), py.alias("py"))
    b = a.join(F.broadcast(S.nested_calibration(other)), ["sca", "ord"])
    qx, qy = S.trace_position("xf", "yf", "wl")
    return b.select("catalog_index", "wl", (F.col("px") - qx).alias("dx"), (F.col("py") - qy).alias("dy"))


@query("trace_offsets", f"SELECT catalog_index, round(min(dy), 4) AS lo, round(avg(dy), 4) AS mean, round(max(dy), 4) AS hi, round(stddev_pop(dy), 4) AS std FROM {OFFS} GROUP BY catalog_index")
def trace_offsets(t):
    return offsets(t).groupBy("catalog_index").agg(r(F.min("dy"), 4).alias("lo"), r(F.avg("dy"), 4).alias("mean"), r(F.max("dy"), 4).alias("hi"), r(F.stddev_pop("dy"), 4).alias("std"))


@query("model_agreement", f"SELECT wl::DOUBLE AS wl, round(max(sqrt(dx * dx + dy * dy)), 4) AS worst FROM {OFFS} GROUP BY wl")
def model_agreement(t):
    return offsets(t).groupBy("wl").agg(r(F.max(F.hypot("dx", "dy")), 4).alias("worst"))


STEPS = "(VALUES (0.001, 0.0), (0.0, 0.001), (0.001, 0.001)) o(ox, oy)"


@query("jacobian_residual", "SELECT catalog_index, round(max(e), 4) AS residual FROM (SELECT b.catalog_index, sqrt(pow(m.px - b.px - o.ox * (jx.px - b.px) / 1e-4 - o.oy * (jy.px - b.px) / 1e-4, 2) + pow(m.py - b.py - o.ox * (jx.py - b.py) / 1e-4 - o.oy * (jy.py - b.py) / 1e-4, 2)) AS e FROM " + STEPS + f" JOIN {traced_sql('(SELECT * FROM (SELECT * FROM ' + NESTED + '), ' + STEPS + ')', '1.4', '(xf + ox)', '(yf + oy)')} m ON m.ox = o.ox AND m.oy = o.oy JOIN {traced_sql(NESTED, '1.4')} b USING (catalog_index) JOIN {traced_sql(NESTED, '1.4', '(xf + 1e-4)', 'yf')} jx USING (catalog_index) JOIN {traced_sql(NESTED, '1.4', 'xf', '(yf + 1e-4)')} jy USING (catalog_index)) GROUP BY catalog_index")
def jacobian_residual(t):
    """Exact against linearised displacement, the worst over a few offsets."""
    at = lambda dx, dy: S.trace_position(F.col("xf") + dx, F.col("yf") + dy, F.lit(1.4))
    names = {"b": (0.0, 0.0), "jx": (1e-4, 0.0), "jy": (0.0, 1e-4), "m0": (0.001, 0.0), "m1": (0.0, 0.001), "m2": (0.001, 0.001)}
    cols = {f"{k}{a}": v for k, (dx, dy) in names.items() for a, v in zip("xy", at(dx, dy), strict=True)}
    df = nested(t).select("catalog_index", *(v.alias(k) for k, v in cols.items()))
    c = F.col
    off = lambda m, ox, oy, a: c(f"{m}{a}") - c(f"b{a}") - ox * (c(f"jx{a}") - c(f"b{a}")) / 1e-4 - oy * (c(f"jy{a}") - c(f"b{a}")) / 1e-4
    worst = F.greatest(*(F.hypot(off(m, ox, oy, "x"), off(m, ox, oy, "y")) for m, ox, oy in (("m0", 0.001, 0.0), ("m1", 0.0, 0.001), ("m2", 0.001, 0.001))))
    return df.select("catalog_index", r(worst, 4).alias("residual"))


PIV = "(SELECT curve, sqrt(sum((w1 - w0) * (s1 * w1 + s0 * w0) / 2) / sum((w1 - w0) * (s1 / w1 + s0 / w0) / 2)) AS pivot FROM (SELECT curve, wavelength AS w0, lead(wavelength) OVER w AS w1, sens AS s0, lead(sens) OVER w AS s1 FROM {curves} WINDOW w AS (PARTITION BY curve ORDER BY wavelength)) WHERE w1 IS NOT NULL GROUP BY curve)"


@query("band_pivot", f"SELECT a.curve, round(a.pivot, 4) AS pivot, round(-5 * log10(a.pivot / b.pivot), 6) + 0.0 AS colour FROM {PIV} a, {PIV} b WHERE b.curve = 1")
def band_pivot(t):
    """Pivot wavelength of each response, and its colour against the first."""
    s = t("curves").withColumns({"tl": F.col("sens") * F.col("wavelength"), "tr": F.col("sens") / F.col("wavelength")})
    num, den = spectra.trapezoid(s, ["curve"], "wavelength", "tl", "num"), spectra.trapezoid(s, ["curve"], "wavelength", "tr", "den")
    p = num.join(den, "curve").select("curve", F.sqrt(F.col("num") / F.col("den")).alias("pivot"))
    one = p.filter("curve = 1").select(F.col("pivot").alias("first"))
    return p.crossJoin(F.broadcast(one)).select("curve", r(F.col("pivot"), 4).alias("pivot"), (r(-5 * F.log10(F.col("pivot") / F.col("first"))) + 0.0).alias("colour"))


@query("stamp_flux_check", "SELECT sca, y, round(sum(value_a) / 1000, 5) AS total, sum(value_a) / 1000 BETWEEN 0.95 AND 1.001 AS ok FROM {pixels} GROUP BY sca, y")
def stamp_flux_check(t):
    total = F.sum("value_a") / 1000
    return t("pixels").groupBy("sca", "y").agg(r(total, 5).alias("total"), total.between(0.95, 1.001).alias("ok"))


@query("footprint_extent", "WITH c AS (SELECT avg(ra) AS ra0, avg(dec) AS dec0 FROM {sources}) SELECT round(any_value(ra0), 6) AS ra0, round(any_value(dec0), 6) AS dec0, round(1.05 * max(greatest(abs(ra - ra0), abs(dec - dec0))), 6) AS half FROM {sources}, c")
def footprint_extent(t):
    c = t("sources").agg(F.avg("ra").alias("ra0"), F.avg("dec").alias("dec0"))
    s = t("sources").crossJoin(F.broadcast(c))
    return s.agg(r(F.first("ra0")).alias("ra0"), r(F.first("dec0")).alias("dec0"), r(1.05 * F.max(F.greatest(F.abs(F.col("ra") - F.col("ra0")), F.abs(F.col("dec") - F.col("dec0"))))).alias("half"))


CORNERS = ((0.5, 0.5), (4088.5, 0.5), (4088.5, 4088.5), (0.5, 4088.5), (2044.5, 2044.5))


@query("detector_footprint", "SELECT pointing_id, sca, k, round((xcen - (kx - crpix) / plate_scale) * plate_scale * pixel_scale / 3600, 6) AS fx, round((ycen + (ky - crpix) / plate_scale) * plate_scale * pixel_scale / 3600, 6) AS fy FROM {visits} JOIN (SELECT * FROM {calibration} WHERE ord = '1') USING (sca), (VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(CORNERS)) + ") v(k, kx, ky)")
def detector_footprint(t):
    """Corners and centre of the detector that each pointing reads, in the focal plane."""
    pts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("px"), F.lit(y).alias("py")) for k, (x, y) in enumerate(CORNERS)))
    detectors = t("calibration").filter("ord = '1'").drop("wl_ref")
    df = t("visits").join(sky.small(detectors), "sca").withColumn("p", F.explode(pts)).select("*", "p.*")
    x, y = S.sca_fpa("px", "py")
    return df.select("pointing_id", "sca", "k", r(x).alias("fx"), r(y).alias("fy"))


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'skipped' ELSE 'ok' END"


@query("status_summary", f"SELECT {STATUS} AS status, count(*) AS n, min(o_orderkey) AS first FROM {{orders}} GROUP BY 1")
def status_summary(t):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("ok")
    return t("orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


BRANCH = 4096
NAMED = "SELECT src_group AS g, catalog_index AS place, 'file_' || catalog_index AS d FROM {sources}"


def level_sql(rows: str) -> str:
    return f"SELECT g, up AS place, sha256(string_agg(d, chr(10) ORDER BY place)) AS d FROM (SELECT *, place // {BRANCH} AS up FROM ({rows})) GROUP BY g, up"


@query("file_list_hash", f"SELECT g AS src_group, substr(sha256(string_agg(d, chr(10) ORDER BY place)), 1, 12) AS hash FROM ({level_sql(level_sql(NAMED))}) GROUP BY g")
def file_list_hash(t):
    """A tree of hashes over each group's names: blocks of at most BRANCH names, blocks of their digests, and one over these."""
    rows = t("sources").select(F.col("src_group").alias("g"), F.col("catalog_index").alias("place"), F.concat(F.lit("file_"), F.col("catalog_index").cast("string")).alias("d"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "d"))), lambda x: x["d"]), "\n"), 256).alias("d")
    for _ in range(2):
        rows = rows.groupBy("g", F.floor(F.col("place") / BRANCH).alias("up")).agg(digest).select("g", F.col("up").alias("place"), "d")
    return rows.groupBy(F.col("g").alias("src_group")).agg(digest).select("src_group", F.substring("d", 1, 12).alias("hash"))


@query("row_in_cell", "SELECT catalog_index, row_number() OVER (PARTITION BY pix // 1024 ORDER BY catalog_index) - 1 AS hp_row FROM {cells}")
def row_in_cell(t):
    w = Window.partitionBy(S.cell_parent("pix", 5)).orderBy("catalog_index")
    return t("cells").select("catalog_index", (F.row_number().over(w) - 1).cast("long").alias("hp_row"))


@query("dense_template_index", "SELECT catalog_index, dense_rank() OVER (ORDER BY sed_index) - 1 AS dense FROM {sources} WHERE sed_index % 3 <> 1")
def dense_template_index(t):
    """Used ids of spectra mapped to 0..k-1, numbered by range."""
    s = t("sources").filter("sed_index % 3 <> 1")
    ids = Q.row_ids(s.select("sed_index").distinct(), "sed_index").select("sed_index", F.col("row_id").alias("dense"))
    return s.join(sky.small(ids), "sed_index").select("catalog_index", "dense")


@query("catalog_row_id", "SELECT catalog_index, row_number() OVER (ORDER BY catalog_index) - 1 AS row_id FROM {sources} QUALIFY catalog_index % 3 = 0")
def catalog_row_id(t):
    """Row numbers made once, before cuts: ranks within key ranges plus the rows before each range."""
    return Q.row_ids(t("sources"), "catalog_index").filter("catalog_index % 3 = 0").select("catalog_index", "row_id")


@query("first_per_source", "SELECT src, sca, catalog_index FROM (SELECT catalog_index % 499 AS src, sca, catalog_index, row_number() OVER (PARTITION BY catalog_index % 499, sca ORDER BY catalog_index) AS n FROM {manifest}) WHERE n = 1")
def first_per_source(t):
    return sky.first_of(t("manifest").select((F.col("catalog_index") % 499).alias("src"), "sca", "catalog_index"), ["src", "sca"], ["catalog_index"])


@query("gradient", "SELECT curve, i, round(CASE WHEN lag(sens) OVER w IS NULL THEN lead(sens) OVER w - sens WHEN lead(sens) OVER w IS NULL THEN sens - lag(sens) OVER w ELSE (lead(sens) OVER w - lag(sens) OVER w) / 2 END, 8) + 0.0 AS grad FROM {curves} WINDOW w AS (PARTITION BY curve ORDER BY wavelength)")
def gradient(t):
    return spectra.gradient(t("curves"), ["curve"], "wavelength", "sens").select("curve", "i", (r(F.col("grad"), 8) + 0.0).alias("grad"))


@query("spacing_check", "SELECT curve, max(abs(d / 200 - 1)) <= 1e-4 AS uniform FROM (SELECT curve, x - lag(x) OVER (PARTITION BY curve ORDER BY x) AS d FROM (SELECT curve, wavelength + CASE WHEN curve % 10 = 3 AND i = 40 THEN 1 ELSE 0 END AS x FROM {curves})) WHERE d IS NOT NULL GROUP BY curve")
def spacing_check(t):
    """Whether each grid is even; one in ten has a sample that is off by one Angstrom."""
    x = F.col("wavelength") + F.when((F.col("curve") % 10 == 3) & (F.col("i") == 40), 1).otherwise(0)
    d = F.col("x") - F.lag("x").over(Window.partitionBy("curve").orderBy("x"))
    return t("curves").withColumn("x", x).withColumn("d", d).filter("d is not null").groupBy("curve").agg((F.max(F.abs(F.col("d") / 200 - 1)) <= 1e-4).alias("uniform"))


@query("segment_bracket", "SELECT curve, wavelength AS x0, round(sens, 6) AS y0, x1, round(y1, 6) AS y1 FROM (SELECT *, lead(wavelength) OVER w AS x1, lead(sens) OVER w AS y1 FROM {curves} WINDOW w AS (PARTITION BY curve ORDER BY wavelength)) WHERE x1 IS NOT NULL")
def segment_bracket(t):
    return spectra.segments(t("curves"), ["curve"], "wavelength", "sens").filter("x1 is not null").select("curve", "x0", r(F.col("y0")).alias("y0"), "x1", r(F.col("y1")).alias("y1"))


@query("cell_offsets", "SELECT cell, (sum(n) OVER (ORDER BY cell) - n)::BIGINT AS start FROM (SELECT pix // 4096 AS cell, count(*) AS n FROM {cells} GROUP BY 1)")
def cell_offsets(t):
    """Start of each cell in concatenated order; the window runs over cells, which a plan holds few of."""
    n = t("cells").groupBy(S.cell_parent("pix", 6).alias("cell")).agg(F.count("*").alias("n"))
    return n.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


@query("empirical_cdf", "SELECT sca, catalog_index, round((row_number() OVER (PARTITION BY sca ORDER BY d_disp_old, catalog_index) - 1) / greatest(count(*) OVER (PARTITION BY sca) - 1, 1), 8) AS frac FROM {residuals}")
def empirical_cdf(t):
    ranked = ranks(t("residuals").select("sca", "catalog_index", "d_disp_old"), ["sca"], "d_disp_old", "catalog_index")
    return ranked.select("sca", "catalog_index", r(F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1)), 8).alias("frac"))


@query("local_dispersion", f"SELECT a.catalog_index, a.line_id, round(1 / sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)), 5) AS per_pixel FROM {traced_sql(LINE_ROWS, 'center_a / 10000')} a JOIN {traced_sql(LINE_ROWS, '(center_a + 1) / 10000')} b USING (catalog_index, line_id)")
def local_dispersion(t):
    """Angstrom per pixel at each line, from positions one Angstrom apart."""
    df = nested(t).crossJoin(F.broadcast(t("lines")))
    (ax, ay), (bx, by) = S.trace_position("xf", "yf", F.col("center_a") / 10000), S.trace_position("xf", "yf", (F.col("center_a") + 1) / 10000)
    return df.select("catalog_index", "line_id", (ax - bx).alias("dx"), (ay - by).alias("dy")).select("catalog_index", "line_id", r(1 / F.hypot("dx", "dy"), 5).alias("per_pixel"))


@query("brightest_n", "SELECT catalog_index, mag FROM {sources} ORDER BY mag, catalog_index LIMIT 25")
def brightest_n(t):
    return t("sources").select("catalog_index", "mag").orderBy("mag", "catalog_index").limit(25)


@query("closest_to_center", "SELECT sca, arg_min(catalog_index, sqrt(pow(xsca - 2044, 2) + pow(ysca - 2044, 2))) AS catalog_index FROM {manifest} GROUP BY sca")
def closest_to_center(t):
    d = F.sqrt(F.pow(F.col("xsca") - 2044, 2) + F.pow(F.col("ysca") - 2044, 2))
    return t("manifest").groupBy("sca").agg(F.min_by("catalog_index", F.struct(d.alias("d"), F.col("catalog_index").alias("c"))).alias("catalog_index"))


@query("seeded_sample", "SELECT type, catalog_index FROM (SELECT type, catalog_index, row_number() OVER (PARTITION BY type ORDER BY sha256('42:' || catalog_index), catalog_index) AS n FROM {sources}) WHERE n <= 50")
def seeded_sample(t):
    """Fifty rows per type by a seeded hash of the id: the same rows on any cluster. Each task first keeps its own fifty."""
    key = F.struct(F.sha2(F.concat(F.lit("42:"), F.col("catalog_index").cast("string")), 256).alias("h"), "catalog_index")
    rows = t("sources").select("type", key.alias("k"), F.spark_partition_id().alias("p"))
    least = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("k"))).filter("n <= 50").drop("n")
    return least(least(rows, "type", "p"), "type").select("type", "k.catalog_index")


@query("even_rank_sample", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY mag, catalog_index) - 1 AS n, count(*) OVER (PARTITION BY type) AS c FROM {sources}) SELECT type, catalog_index FROM k WHERE EXISTS (SELECT 1 FROM (VALUES (0), (1), (2), (3), (4)) v(j) WHERE k.n = floor(v.j * (k.c - 1) / 4.0))")
def even_rank_sample(t):
    """Five rows per type, evenly spaced in order of magnitude."""
    k = ranks(t("sources").select("type", "catalog_index", "mag"), ["type"], "mag", "catalog_index")
    wanted = F.array(*(F.floor(j * (F.col("n") - 1) / 4.0) for j in range(5)))
    return k.filter(F.array_contains(wanted, F.col("rank").cast("long"))).select("type", "catalog_index")


@query("union_catalogs", "SELECT catalog_index, type, mag, NULL::DOUBLE AS radius FROM {sources} WHERE type = 'PSF' UNION ALL SELECT catalog_index, type, mag, half_light_radius FROM {sources} WHERE type = 'SER' AND half_light_radius > 0.8".replace("NULL::DOUBLE", "-1.0::DOUBLE"))
def union_catalogs(t):
    s = t("sources")
    stars = s.filter("type = 'PSF'").select("catalog_index", "type", "mag")
    parts = s.filter("type = 'SER' and half_light_radius > 0.8").select("mag", "type", "catalog_index", F.col("half_light_radius").alias("radius"))
    return stars.unionByName(parts, allowMissingColumns=True).na.fill(-1.0, ["radius"])


@query("pad_periodic", "SELECT catalog_index, k, round(ra + 2.01 * k, 6) AS ra FROM {sources}, (SELECT unnest(range(-2, 4)) AS k) WHERE ra + 2.01 * k >= 8.0 AND ra + 2.01 * k < 14.0")
def pad_periodic(t):
    """Whole-period copies in right ascension, trimmed to a half-open range."""
    s = t("sources").withColumn("k", F.explode(F.sequence(F.lit(-2).cast("long"), F.lit(3).cast("long"))))
    s = s.withColumn("ra", F.col("ra") + 2.01 * F.col("k")).filter("ra >= 8.0 and ra < 14.0")
    return s.select("catalog_index", "k", r(F.col("ra")).alias("ra"))


@query("unplanned_cells", "SELECT DISTINCT pix // 256 AS cell FROM {cells} EXCEPT SELECT pix // 256 FROM {cells} WHERE pix // 256 % 50 <> 7")
def unplanned_cells(t):
    """Stored cells that a plan lacks, one in fifty being left out of it."""
    cell = S.cell_parent("pix", 4).alias("cell")
    return t("cells").select(cell).subtract(t("cells").select(cell).filter("cell % 50 <> 7"))


AFTER = "SELECT catalog_index, ra, dec, type, CASE WHEN catalog_index % 1000 = 7 THEN mag + 1 ELSE mag END AS mag FROM {sources} WHERE catalog_index % 1000 <> 11 UNION ALL SELECT catalog_index, ra, dec, type, mag FROM {sources} WHERE catalog_index % 1000 = 13"
BEFORE = "SELECT catalog_index, ra, dec, type, mag FROM {sources}"


@query("rows_unchanged", f"SELECT (SELECT count(*) FROM {{sources}}) AS n, (SELECT count(*) FROM ({BEFORE} EXCEPT ALL ({AFTER}))) AS lost, (SELECT count(*) FROM (({AFTER}) EXCEPT ALL {BEFORE})) AS added")
def rows_unchanged(t):
    """Rows that a transform lost or added, both ways: here it changes some, drops some and repeats some."""
    cols = ["catalog_index", "ra", "dec", "type", "mag"]
    a = t("sources").select(cols)
    moved = F.when(F.col("catalog_index") % 1000 == 7, F.col("mag") + 1).otherwise(F.col("mag"))
    b = a.filter("catalog_index % 1000 <> 11").withColumn("mag", moved).unionAll(a.filter("catalog_index % 1000 = 13"))
    lost, added = a.exceptAll(b).agg(F.count("*").alias("lost")), b.exceptAll(a).agg(F.count("*").alias("added"))
    return a.agg(F.count("*").alias("n")).crossJoin(lost).crossJoin(added)


SCHEMA_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', '{u}', '{d}')" for n, k, u, d in (("ra", "double", "deg", "right ascension"), ("dec", "double", "deg", "declination"), ("type", "string", "", "PSF or SER"), ("n", "float", "", "Sersic index"), ("half_light_radius", "float", "arcsec", "half-light radius"), ("pa", "float", "deg", "position angle"), ("ba", "float", "", "axis ratio"), ("F158", "float", "maggies", "flux in the reference band"), ("z_obs", "float", "", "observed redshift"), ("z_cosmo", "float", "", "cosmological redshift"), ("sed_index", "int", "", "row of the spectrum"), ("flux_scale", "float", "", "factor on the spectrum"), ("sim", "smallint", "", "partition of the spectrum"), ("src_index", "int", "", "row in the original"))) + ") v(name, type, unit, description)"


@query("catalog_schema", SCHEMA_SQL)
def catalog_schema(t):
    return readers.column_dictionary(readers.as_catalog(t("sources")).limit(0))


GIVEN = ("ra", "dec", "type", "half_light_radius", "z_obs", "sed_index", "flux_scale", "sim")


@query("column_dictionary", f"SELECT d.*, CASE WHEN name IN {GIVEN} THEN (SELECT count(*) FROM {{sources}}) ELSE 0 END AS filled FROM ({SCHEMA_SQL}) d")
def column_dictionary(t):
    """Each column's type, unit and description, and how many rows fill it."""
    df = readers.as_catalog(t("sources"))
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
    filled = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in df.columns))).alias("x")).select("x.*")
    return readers.column_dictionary(df).join(filled, "name")


@query("read_source_index", "SELECT ra, dec, sim::SMALLINT AS sim, sed_index::INT AS idx, mag::FLOAT AS mag, z_obs::FLOAT AS z FROM {sources}")
def read_source_index(t):
    return readers.read_source_index(t("sources"))


@query("read_sensitivity", "SELECT p.s_suppkey AS sca, c.wavelength, round(c.sens, 6) AS sens FROM {supplier} p JOIN {curves} c ON c.curve = p.s_suppkey % 100")
def read_sensitivity(t):
    """The curve of each instrument, by a map from instruments to names of curves."""
    curves = t("curves").select(F.concat(F.lit("curve_"), "curve").alias("curve"), "wavelength", "sens", F.lit("1").alias("ord"))
    mapping = t("supplier").select(F.col("s_suppkey").alias("sca"), F.concat(F.lit("curve_"), F.col("s_suppkey") % 100).alias("curve"))
    return readers.read_sensitivity(mapping, curves, mapping.select("sca")).select("sca", "wavelength", r(F.col("sens")).alias("sens"))
