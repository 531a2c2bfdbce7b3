"""Queries for aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import scalar as S
from skyloom.operators import cells, fits, spectra
from skyloom.operators import pixels as P
from skyloom.operators.cells import sky_cells
from skyloom.operators.quantiles import exact_quantiles, medians
from skyloom.operators.sky import small
from skyloom.plans.join_queries import TRUTH, galaxies, line_truth_rows
from skyloom.plans.registry import query
from skyloom.plans.scalar_queries import NESTED, nested, r, sky_cell_sql, traced_sql
from skyloom.sources import readers

GRAD = "CASE WHEN lag(wavelength) OVER w IS NULL THEN lead(wavelength) OVER w - wavelength WHEN lead(wavelength) OVER w IS NULL THEN wavelength - lag(wavelength) OVER w ELSE (lead(wavelength) OVER w - lag(wavelength) OVER w) / 2 END"
WEIGHT = f"(SELECT i, wavelength, transmission * wavelength * {GRAD} AS w FROM {{bandpass}} WINDOW w AS (ORDER BY wavelength))"
LONG = "(SELECT vec_id, sim, sed_index, unnest(range(0, 64)) AS i, abs(unnest(embedding)::DOUBLE) AS f FROM {spectra})"
FLUX = f"(SELECT vec_id, any_value(sim) AS sim, any_value(sed_index) AS sed_index, sum(f * w) / sum(w) AS flux FROM {LONG} JOIN {WEIGHT} USING (i) GROUP BY vec_id)"


def weights(t):
    """Transmission x wavelength x spacing, per sample of the band. The grid is one small curve."""
    b = t("bandpass").withColumn("one", F.lit(1))
    return spectra.gradient(b, ["one"], "wavelength").select("i", "wavelength", (F.col("transmission") * F.col("wavelength") * F.col("grad")).alias("w"))


def weight_array(t):
    return weights(t).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("w"))


def band_flux(t):
    df = t("spectra").select("vec_id", "sim", "sed_index", spectra.flux_array("embedding").alias("seds"))
    return df.crossJoin(F.broadcast(weight_array(t))).withColumn("flux", spectra.weighted_mean(F.col("seds"), F.col("w")))


@query("bandpass_weights", f"WITH w AS (SELECT curve, i, sens * wavelength * {GRAD} AS w FROM {{curves}} WINDOW w AS (PARTITION BY curve ORDER BY wavelength)) SELECT curve, i, round(w, 4) AS w, round(sum(w) OVER (PARTITION BY curve), 4) AS total FROM w")
def bandpass_weights(t):
    """Response x wavelength x spacing of each sample of each curve, with the curve's sum."""
    w = spectra.gradient(t("curves"), ["curve"], "wavelength").withColumn("w", F.col("sens") * F.col("wavelength") * F.col("grad"))
    return w.withColumn("total", F.sum("w").over(Window.partitionBy("curve"))).select("curve", "i", r(F.col("w"), 4).alias("w"), r(F.col("total"), 4).alias("total"))


@query("bandpass_flux", f"SELECT vec_id, round(flux, 6) AS flux FROM {FLUX}")
def bandpass_flux(t):
    return band_flux(t).select("vec_id", r(F.col("flux")).alias("flux"))


@query("synthetic_mag", f"SELECT vec_id, round(-2.5 * log10(flux), 5) AS mag FROM {FLUX}")
def synthetic_mag(t):
    return band_flux(t).select("vec_id", r(S.flux_to_mag("flux"), 5).alias("mag"))


NU = "(SELECT vec_id, i, abs(f) * 2.99792458e18 / pow(9000 + 200.0 * i, 2) / 1e10 AS f FROM {0})"
FLAM = f"(SELECT vec_id, sum(f * w) / sum(w) AS flux, sum(f) AS total FROM {NU.format(LONG)} JOIN {WEIGHT} USING (i) GROUP BY vec_id)"


@query("normalize_seds", f"SELECT vec_id, round(pow(10, -0.4 * (vec_id % 7)) / flux, 5) AS scale, round(pow(10, -0.4 * (vec_id % 7)) / flux * total, 4) AS total FROM {FLAM}")
def normalize_seds(t):
    """Spectra per frequency, turned to spectra per wavelength (in units of 1e10), scaled so that the synthetic magnitude equals the wanted one."""
    df = t("spectra").crossJoin(F.broadcast(weight_array(t)))
    flam = F.transform(spectra.flux_array("embedding"), lambda f, i: S.fnu_to_flam(f, 9000 + 200.0 * i) / 1e10)
    df = df.select("vec_id", flam.alias("seds"), "w").withColumn("flux", spectra.weighted_mean(F.col("seds"), F.col("w")))
    df = df.withColumn("scale", F.pow(F.lit(10.0), -0.4 * (F.col("vec_id") % 7)) / F.col("flux"))
    done = df.withColumn("seds", F.transform("seds", lambda x: x * F.col("scale")))
    return done.select("vec_id", r(F.col("scale"), 5).alias("scale"), r(F.aggregate("seds", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


OWN_GRID = f"(SELECT vec_id, 8900 + 205.0 * i AS x0, f AS y0, lead(8900 + 205.0 * i) OVER w AS x1, lead(f) OVER w AS y1 FROM {LONG} WINDOW w AS (PARTITION BY vec_id ORDER BY i))"
SAMPLED = f"(SELECT s.vec_id, b.i, CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (b.wavelength - x0) / (x1 - x0) * (y1 - y0) END AS f FROM {OWN_GRID} s JOIN {{bandpass}} b ON b.wavelength >= s.x0 AND (s.x1 IS NULL OR b.wavelength < s.x1))"


@query("normalize_templates", f"SELECT vec_id, round(sum(w) / sum(f * w), 5) AS scale FROM {SAMPLED} JOIN {WEIGHT} USING (i) GROUP BY vec_id")
def normalize_templates(t):
    """Templates on a wavelength grid of their own, interpolated to the catalog's, scaled to magnitude 0."""
    curve = t("spectra").select("vec_id", F.posexplode(spectra.flux_array("embedding")).alias("k", "y")).withColumn("x", 8900 + 205.0 * F.col("k"))
    points = t("spectra").select("vec_id").crossJoin(F.broadcast(weights(t)))
    sampled = spectra.interp_join(points, curve.select("vec_id", "x", "y"), ["vec_id"], "wavelength")
    return sampled.groupBy("vec_id").agg(r(F.sum("w") / F.sum(F.col("value") * F.col("w")), 5).alias("scale"))


@query("mag_roundtrip", f"SELECT kind, round(median(d), 6) AS med, round(max(abs(d)), 6) AS worst, round(stddev_pop(d), 6) AS spread, count(*) FILTER (abs(d) <= 0.01) AS passed FROM (SELECT vec_id % 2 AS kind, -2.5 * log10(flux) - (0.4 + vec_id % 3 / 10.0) AS d FROM {FLUX}) GROUP BY kind")
def mag_roundtrip(t):
    d = band_flux(t).select((F.col("vec_id") % 2).alias("kind"), (S.flux_to_mag("flux") - (0.4 + F.col("vec_id") % 3 / 10.0)).alias("d"))
    return d.groupBy("kind").agg(r(F.percentile("d", F.lit(0.5))).alias("med"), r(F.max(F.abs("d"))).alias("worst"), r(F.stddev_pop("d")).alias("spread"), F.count_if(F.abs("d") <= 0.01).alias("passed"))


@query("color_diagnostic", f"SELECT sim, round(median(e), 6) AS med, round(quantile_cont(e, 0.9), 6) AS p90, round(quantile_cont(e, 0.95), 6) AS p95 FROM (SELECT sim, abs(-2.5 * log10(flux / (SELECT sum(f) / 64 FROM {LONG} l WHERE l.vec_id = x.vec_id))) AS e FROM {FLUX} x) GROUP BY sim")
def color_diagnostic(t):
    plain = F.aggregate("seds", F.lit(0.0), lambda a, x: a + x) / 64
    e = band_flux(t).select("sim", F.abs(-2.5 * F.log10(F.col("flux") / plain)).alias("e"))
    q = e.groupBy("sim").agg(F.percentile("e", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("q"))
    return q.select("sim", r(F.col("q")[0]).alias("med"), r(F.col("q")[1]).alias("p90"), r(F.col("q")[2]).alias("p95"))


@query("sed_sanity", "SELECT vec_id, round(list_count(list_filter(embedding, lambda x: x > 0)) / 64.0, 6) AS positive, list_max(embedding) > 0 AS some FROM {spectra}")
def sed_sanity(t):
    return t("spectra").select("vec_id", r(F.size(F.filter("embedding", lambda x: x > 0)) / F.size("embedding")).alias("positive"), (F.array_max("embedding") > 0).alias("some"))


@query("sed_scrub", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) > 0.15 THEN 0.0 ELSE x::DOUBLE END)), 5) + 0.0 AS total FROM {spectra}")
def sed_scrub(t):
    clean = spectra.scrub(F.transform("embedding", lambda x: x.cast("double")), 0.15)
    return t("spectra").select("vec_id", (r(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"))


@query("sed_scrub_report", "SELECT sim, sed_index, len(list_filter(embedding, lambda x: abs(x::DOUBLE) > 0.15)) AS zeroed, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS largest FROM {spectra} WHERE len(list_filter(embedding, lambda x: abs(x::DOUBLE) > 0.15)) > 0")
def sed_scrub_report(t):
    bad = F.filter("embedding", lambda x: F.abs(x.cast("double")) > 0.15)
    df = t("spectra").dropDuplicates(["sim", "sed_index"]).select("sim", "sed_index", F.size(bad).cast("long").alias("zeroed"), r(F.array_max(spectra.flux_array("embedding"))).alias("largest"))
    return df.filter("zeroed > 0")


RATE = "(SELECT sca, ord, mag, sum(p) AS rate FROM (SELECT sca, ord, mag, (lead(wavelength) OVER w - wavelength) * (lead(v) OVER w + v) / 2 AS p FROM (SELECT sca, ord, m.mag, wavelength, sens * 3.631e-20 * 2.99792458e18 / (wavelength * wavelength) * pow(10, -0.4 * m.mag) * 1e12 AS v FROM {sensitivity}, (SELECT DISTINCT floor(mag) AS mag FROM {sources}) m) WINDOW w AS (PARTITION BY sca, ord, mag ORDER BY wavelength)) GROUP BY ALL)"


def rates(t):
    """Count rate of a flat source of each whole magnitude, on each detector and order."""
    mags = small(t("sources").select(F.floor("mag").cast("double").alias("mag")).distinct())
    v = F.col("sens") * S.flat_ab_flam("wavelength", "mag") * 1e12
    return spectra.trapezoid(t("sensitivity").crossJoin(mags).withColumn("v", v), ["sca", "ord", "mag"], "wavelength", "v", "rate")


@query("count_rate", f"SELECT sca, ord, mag, round(rate, 3) AS rate FROM {RATE}")
def count_rate(t):
    return rates(t).select("sca", "ord", "mag", r(F.col("rate"), 3).alias("rate"))


@query("median_over_detectors", f"SELECT ord, mag, round(median(rate), 3) AS rate FROM {RATE} GROUP BY ord, mag")
def median_over_detectors(t):
    """Over the 18 detectors, so each group has as many values."""
    return rates(t).groupBy("ord", "mag").agg(r(F.percentile("rate", F.lit(0.5)), 3).alias("rate"))


AT_REF = "(SELECT sca, ord, y0 + (15510 - x0) / (x1 - x0) * (y1 - y0) AS sens FROM (SELECT sca, ord, wavelength AS x0, sens AS y0, lead(wavelength) OVER w AS x1, lead(sens) OVER w AS y1 FROM {sensitivity} WINDOW w AS (PARTITION BY sca, ord ORDER BY wavelength)) WHERE 15510 >= x0 AND 15510 < x1)"


@query("rate_per_resel", f"SELECT sca, ord, mag, round(sens * 3.631e-20 * 2.99792458e18 / (15510.0 * 15510) * pow(10, -0.4 * mag) * 1e12 * 20, 5) AS rate FROM {AT_REF}, (SELECT DISTINCT floor(mag) AS mag FROM {{sources}})")
def rate_per_resel(t):
    """Rate in one element of 20 Angstrom at 15510, with the sensitivity interpolated there."""
    mags = t("sources").select(F.floor("mag").cast("double").alias("mag")).distinct()
    places = t("calibration").select("sca", "ord", F.lit(15510.0).alias("at"))
    df = spectra.interp_join(places, t("sensitivity"), ["sca", "ord"], "at", "wavelength", "sens").crossJoin(F.broadcast(mags))
    return df.select("sca", "ord", "mag", r(F.col("value") * S.flat_ab_flam("at", "mag") * 1e12 * 20, 5).alias("rate"))


@query("snr_table", f"SELECT ord, mag, n_exp, round(s * n_exp / sqrt(s * n_exp + 100 * n_exp), 4) AS snr FROM (SELECT ord, mag, median(rate) * 190 AS s FROM {RATE} GROUP BY ord, mag), (VALUES (1), (8), (32)) e(n_exp)")
def snr_table(t):
    s = rates(t).groupBy("ord", "mag").agg((F.percentile("rate", F.lit(0.5)) * 190).alias("s"))
    df = s.withColumn("n_exp", F.explode(F.array(F.lit(1), F.lit(8), F.lit(32))))
    n = F.col("n_exp")
    return df.select("ord", "mag", "n_exp", r(F.col("s") * n / F.sqrt(F.col("s") * n + 100 * n), 4).alias("snr"))


@query("counts_per_bin", f"SELECT vec_id, sca, ord, round(sum(f * sens * 200), 4) AS counts FROM {LONG} JOIN {{sensitivity}} USING (i) GROUP BY ALL")
def counts_per_bin(t):
    """Counts of each spectrum through each detector's and order's curve, of which there are 54."""
    sens = t("sensitivity").groupBy("sca", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sens"))), lambda x: x["sens"]).alias("s"))
    df = t("spectra").crossJoin(F.broadcast(sens))
    c = F.zip_with(spectra.flux_array("embedding"), "s", lambda f, s: f * s * 200)
    return df.select("vec_id", "sca", "ord", r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4).alias("counts"))


@query("response_peak", "SELECT curve, round(max(sens), 6) AS peak, arg_max(wavelength, sens * 1e9 + wavelength) AS at, round(avg(sens) / max(sens), 6) AS relative FROM {curves} GROUP BY curve")
def response_peak(t):
    return t("curves").groupBy("curve").agg(r(F.max("sens")).alias("peak"), F.max_by("wavelength", F.col("sens") * 1e9 + F.col("wavelength")).alias("at"), r(F.avg("sens") / F.max("sens")).alias("relative"))


@query("manifest_pivot", "SELECT ord, count(*) FILTER (type = 'PSF') AS \"PSF\", count(*) FILTER (type = 'SER') AS \"SER\" FROM {manifest} GROUP BY ord")
def manifest_pivot(t):
    return t("manifest").groupBy("ord").pivot("type", ["PSF", "SER"]).agg(F.count("catalog_index")).na.fill(0)


@query("catalog_totals", "SELECT count(*) AS n, count(*) FILTER (type = 'PSF') AS stars, count(*) FILTER (type = 'SER') AS galaxies, count(DISTINCT sim) AS sims, min(mag) AS lo, max(mag) AS hi FROM {sources}")
def catalog_totals(t):
    return t("sources").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "PSF").alias("stars"), F.count_if(F.col("type") == "SER").alias("galaxies"), F.count_distinct("sim").alias("sims"), F.min("mag").alias("lo"), F.max("mag").alias("hi"))


@query("residual_by_sca", "SELECT sca, round(median(d_disp_old), 6) AS med FROM {residuals} GROUP BY sca")
def residual_by_sca(t):
    return medians(t("residuals"), ["sca"], "d_disp_old", "med").withColumn("med", r(F.col("med")))


def robust(d, keys):
    """Median, median absolute deviation, rms and largest absolute value of ``x`` per group; ``d`` is a written table, as it is read several times."""
    of = lambda df, extra: df.groupBy(*keys).agg(*extra)
    med = exact_quantiles(d, keys, F.col("x"), [0.5]).select(*keys, F.col("q")[0].alias("med"))
    both = d.join(small(med), keys) if keys else d.crossJoin(F.broadcast(med))
    mad = exact_quantiles(both, keys, F.abs(F.col("x") - F.col("med")), [0.5]).select(*keys, F.col("q")[0].alias("mad"))
    rest = of(d, [F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("worst"), F.count("*").alias("n")])
    join = lambda a, b: a.join(b, keys) if keys else a.crossJoin(b)
    return join(join(med, mad), rest).select(*keys, *(r(F.col(c)).alias(c) for c in ("med", "mad", "rms", "worst")), "n")


def old_residuals(t):
    return readers.kept(t("residuals").select("sca", F.col("d_disp_old").alias("x")).filter(~F.isnan("x")))


@query("robust_summary", "WITH m AS (SELECT median(d_disp_old) AS med FROM {residuals}) SELECT round(any_value(med), 6) AS med, round(median(abs(d_disp_old - med)), 6) AS mad, round(sqrt(avg(d_disp_old * d_disp_old)), 6) AS rms, round(max(abs(d_disp_old)), 6) AS worst FROM {residuals}, m")
def robust_summary(t):
    return robust(old_residuals(t), []).drop("n")


@query("robust_summary_total", "WITH d AS (SELECT sca, d_disp_old AS x FROM {residuals} UNION ALL SELECT 0, d_disp_old FROM {residuals}), m AS (SELECT sca, median(x) AS med FROM d GROUP BY sca) SELECT sca, round(any_value(med), 6) AS med, round(median(abs(x - med)), 6) AS mad, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS worst, count(*) AS n FROM d JOIN m USING (sca) GROUP BY sca")
def robust_summary_total(t):
    """Per detector and, as detector 0, over all, in the same passes over one written table."""
    d = old_residuals(t)
    return robust(d.unionByName(d.withColumn("sca", F.lit(0))), ["sca"])


@query("shift_quantiles", "WITH d AS (SELECT sca, abs(d_disp_new - d_disp_old) AS d FROM {residuals}), m AS (SELECT sca, median(d) AS med FROM d GROUP BY sca) SELECT round(median(d), 6) AS med, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS worst, (SELECT round(min(med), 6) FROM m) AS lo, (SELECT round(max(med), 6) FROM m) AS hi FROM d")
def shift_quantiles(t):
    d = readers.kept(t("residuals").select("sca", F.abs(F.col("d_disp_new") - F.col("d_disp_old")).alias("d")))
    q = exact_quantiles(d, [], F.col("d"), [0.5, 0.95, 1.0]).select(*(r(F.col("q")[i]).alias(c) for i, c in enumerate(("med", "p95", "worst"))))
    m = exact_quantiles(d, ["sca"], F.col("d"), [0.5]).agg(r(F.min(F.col("q")[0])).alias("lo"), r(F.max(F.col("q")[0])).alias("hi"))
    return q.crossJoin(F.broadcast(m))


@query("blast_radius", "SELECT variant, round(max(abs(b - a)), 6) AS radius FROM (SELECT sca, catalog_index % 3 AS variant, median(d_disp_old) AS a, median(d_disp_new) AS b FROM {residuals} GROUP BY 1, 2) GROUP BY variant")
def blast_radius(t):
    d = readers.kept(t("residuals").withColumn("variant", F.col("catalog_index") % 3))
    old = medians(d, ["sca", "variant"], "d_disp_old", "a")
    new = medians(d, ["sca", "variant"], "d_disp_new", "b")
    return old.join(new, ["sca", "variant"]).groupBy("variant").agg(r(F.max(F.abs(F.col("b") - F.col("a")))).alias("radius"))


@query("describe_by_group", "SELECT sca, count(*) AS n, round(avg(d_disp_old), 6) AS mean, round(stddev_samp(d_disp_old), 6) AS std, round(min(d_disp_old), 6) AS lo, round(quantile_cont(d_disp_old, 0.25), 6) AS q1, round(median(d_disp_old), 6) AS q2, round(quantile_cont(d_disp_old, 0.75), 6) AS q3, round(max(d_disp_old), 6) AS hi FROM {residuals} GROUP BY sca")
def describe_by_group(t):
    d, x = readers.kept(t("residuals").select("sca", "d_disp_old")), F.col("d_disp_old")
    q = exact_quantiles(d, ["sca"], x, [0.25, 0.5, 0.75]).select("sca", *(r(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3)))
    rest = d.groupBy("sca").agg(F.count("*").alias("n"), r(F.avg(x)).alias("mean"), r(F.stddev_samp(x)).alias("std"), r(F.min(x)).alias("lo"), r(F.max(x)).alias("hi"))
    return rest.join(q, "sca")


SURFACE = [(i, j) for i in range(4) for j in range(4 - i)]
SURFACE_SQL = f"SELECT sca, mag / 10 AS d, [{', '.join(f'pow((xsca - 2044) / 2300, {i}) * pow((ysca - 2044) / 2300, {j})' for i, j in SURFACE)}] AS f FROM {{manifest}}"
SYSTEM = ", ".join("[" + ", ".join([f"sum(f[{i}] * f[{j}])" + (" + 1e-9" if i == j else "") for j in range(1, 11)] + [f"sum(f[{i}] * d)"]) + "]" for i in range(1, 11))
SMOOTH = f"""WITH RECURSIVE p AS MATERIALIZED ({SURFACE_SQL}),
g AS (SELECT sca, 1 AS k, m FROM (SELECT sca, [{SYSTEM}] AS m FROM p GROUP BY sca HAVING count(*) >= 40)
UNION ALL SELECT sca, k + 1, [CASE WHEN i = k THEN [v / m[k][k] FOR v IN a] ELSE [a[j] - a[k] / m[k][k] * m[k][j] FOR j IN range(1, 12)] END FOR a, i IN m] FROM g WHERE k <= 10)
SELECT sca, round(sqrt(avg(pow(d - list_sum([f[j] * m[j][11] FOR j IN range(1, 11)]), 2))), 5) AS rms, count(*) AS n FROM p JOIN g USING (sca) WHERE k = 11 GROUP BY sca"""


@query("poly_smoothness", SMOOTH)
def poly_smoothness(t):
    """Rms about a bivariate cubic of each detector's residuals. Sums of normal equations per detector, one small solve each; no Python."""
    u, v = (F.col("xsca") - 2044) / 2300, (F.col("ysca") - 2044) / 2300
    terms = F.array(*(F.pow(u, F.lit(i)) * F.pow(v, F.lit(j)) for i, j in SURFACE))
    m = t("manifest").select("sca", (F.col("mag") / 10).alias("d"), terms.alias("f"))
    fit = m.groupBy("sca").agg(F.count("*").alias("n"), fits.normal_equations(F.col("f"), len(SURFACE), F.col("d"), 1e-9).alias("s"))
    fit = small(fit.filter("n >= 40").select("sca", fits.solved(F.col("s"), len(SURFACE)).alias("w")))
    model = F.aggregate(F.zip_with("f", "w", lambda f, w: f * w), F.lit(0.0), lambda a, x: a + x)
    return m.join(fit, "sca").groupBy("sca").agg(r(F.sqrt(F.avg(F.pow(F.col("d") - model, 2))), 5).alias("rms"), F.count("*").alias("n"))


@query("linear_baseline", "SELECT sca, round(regr_slope(value_a, x), 6) AS slope, round(regr_intercept(value_a, x), 4) AS level FROM {pixels} WHERE abs(x - 32) > 5 GROUP BY sca")
def linear_baseline(t):
    return t("pixels").filter(F.abs(F.col("x") - 32) > 5).groupBy("sca").agg(r(F.regr_slope("value_a", "x")).alias("slope"), r(F.regr_intercept("value_a", "x"), 4).alias("level"))


PLAN = "(SELECT pix // 4096 AS cell, count(*) AS n_rows, count(*) * 256.0::DOUBLE AS est_bytes FROM {cells} GROUP BY 1)"


def plan(t):
    return t("cells").groupBy(S.cell_parent("pix", 6).alias("cell")).agg(F.count("*").alias("n_rows"), (F.count("*") * 256.0).alias("est_bytes"))


@query("cell_plan", f"SELECT 4 * 4096 + cell AS hp_uniq, 6 AS ord, n_rows, est_bytes FROM {PLAN}")
def cell_plan(t):
    return plan(t).select(S.uniq_pack(6, F.col("cell")).alias("hp_uniq"), F.lit(6).alias("ord"), "n_rows", "est_bytes")


@query("plan_stats", f"SELECT min(n_rows) AS lo, median(n_rows) AS med, max(n_rows) AS hi, sum(n_rows)::BIGINT AS total, sum(est_bytes) AS bytes, count(*) AS n FROM {PLAN}")
def plan_stats(t):
    return plan(t).agg(F.min("n_rows").alias("lo"), F.percentile("n_rows", F.lit(0.5)).alias("med"), F.max("n_rows").alias("hi"), F.sum("n_rows").alias("total"), F.sum("est_bytes").alias("bytes"), F.count("*").alias("n"))


@query("fixed_cells", "SELECT pix // 1024 AS cell, count(*) AS n FROM {cells} GROUP BY 1")
def fixed_cells(t):
    return t("cells").groupBy(S.cell_parent("pix", 5).alias("cell")).agg(F.count("*").alias("n"))


#: Orders of the cover, bytes of a row and of a cell.
COVER = (2, 9, 256.0, 30720.0)
FINE = f"fine AS MATERIALIZED ({sky_cell_sql('ra', 'dec', COVER[1]).replace('{rows}', '(SELECT catalog_index, ra, dec FROM {sources})')})"
COUNTS = "counts AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {o} AS ord, cell // {4 ** (COVER[1] - o)} AS cell, count(*) AS n FROM fine GROUP BY 2" for o in range(COVER[0], COVER[1] + 1)) + ")"
FITS = f"SELECT c.ord, c.cell::BIGINT AS cell, c.n, CAST(c.n * {COVER[2]} AS DOUBLE) AS est_bytes, c.n * {COVER[2]} > {COVER[3]} AS oversize FROM counts c LEFT JOIN counts p ON p.ord = c.ord - 1 AND p.cell = c.cell // 4 WHERE (c.n * {COVER[2]} <= {COVER[3]} OR c.ord = {COVER[1]}) AND (c.ord = {COVER[0]} OR p.n * {COVER[2]} > {COVER[3]})"


def covered(t):
    fine = readers.kept(sky_cells(t("sources"), COVER[1]).select("catalog_index", "fine"))
    return fine, cells.cover(fine, "fine", *COVER)


@query("adaptive_cells", f"WITH {FINE}, {COUNTS} {FITS}")
def adaptive_cells(t):
    """Cells split by bytes until they fit; those of the finest order that don't are oversize."""
    return covered(t)[1].select("ord", "cell", F.col("n_rows").alias("n"), "est_bytes", "oversize")


@query("adaptive_placement", f"WITH {FINE}, {COUNTS}, cover AS ({FITS}) SELECT catalog_index, c.ord, 4 * pow(4, c.ord)::BIGINT + c.cell AS hp_uniq FROM fine f JOIN cover c ON f.cell // pow(4, {COVER[1]} - c.ord)::BIGINT = c.cell")
def adaptive_placement(t):
    """The cell of the cover that each source lies in, by ranges of finest cells."""
    fine, plan = covered(t)
    return cells.placed(fine, "fine", readers.kept(plan), *COVER[:2]).select("catalog_index", "ord", "hp_uniq")


@query("oversize_cells", f"WITH {FINE}, {COUNTS}, cover AS ({FITS}) SELECT ord, count(*) AS n_cells, count(*) FILTER (oversize) AS n_oversize, max(est_bytes) AS largest FROM cover GROUP BY ord")
def oversize_cells(t):
    """Cells of each order in the cover, and how many are over the target because they can't be split further."""
    return covered(t)[1].groupBy("ord").agg(F.count("*").alias("n_cells"), F.count_if("oversize").alias("n_oversize"), F.max("est_bytes").alias("largest"))


@query("image_diff", "SELECT sca, round(sum(a), 3) AS total, round((sum(b) - sum(a)) / sum(a), 9) AS rel, round(max(abs(b - a)), 6) AS worst, count(*) FILTER (abs(b - a) > 1e-8 + 5e-5 * abs(a)) AS failing FROM (SELECT sca, y, x, sum(a) AS a, sum(b) AS b FROM (SELECT sca, y, x, value_a AS a, 0 AS b FROM {pixels} WHERE (x + y) % 9 <> 0 UNION ALL SELECT sca, y, x, 0, value_b FROM {pixels} WHERE (x + y) % 11 <> 0) GROUP BY ALL) GROUP BY sca")
def image_diff(t):
    a = t("pixels").filter("(x + y) % 9 <> 0").select("sca", "y", "x", F.col("value_a").alias("value"))
    b = t("pixels").filter("(x + y) % 11 <> 0").select("sca", "y", "x", F.col("value_b").alias("value"))
    return P.image_diff(a, b, ["sca"], 5e-5, 1e-8)


@query("count_flips", "SELECT sca, count(*) FILTER (round_even(value_a, 0) <> round_even(value_b * 1.001, 0)) AS differ, count(*) FILTER (round_even(value_a, 0) <> round_even(value_b * 1.001, 0) AND abs(value_a - value_b) < 1e-3) AS same_rate, round(max(abs(round_even(value_a, 0) - round_even(value_b * 1.001, 0)) / sqrt(value_a)), 6) AS sigma FROM {pixels} GROUP BY sca")
def count_flips(t):
    a, b = F.rint("value_a"), F.rint(F.col("value_b") * 1.001)
    p = t("pixels")
    return p.groupBy("sca").agg(F.count_if(a != b).alias("differ"), F.count_if((a != b) & (F.abs(F.col("value_a") - F.col("value_b")) < 1e-3)).alias("same_rate"), r(F.max(F.abs(a - b) / F.sqrt("value_a"))).alias("sigma"))


@query("centroid", "SELECT sca, round(sum(x * greatest(value_a - 20, 0)) / sum(greatest(value_a - 20, 0)), 6) AS cx, round(sum(y * greatest(value_a - 20, 0)) / sum(greatest(value_a - 20, 0)), 6) AS cy, round(sum(x * greatest(value_a - 20, 0)) / sum(greatest(value_a - 20, 0)) - sum(x * greatest(value_b - 30, 0)) / sum(greatest(value_b - 30, 0)), 6) AS shift FROM {pixels} GROUP BY sca")
def centroid(t):
    a, b = F.col("value_a") - 20, F.col("value_b") - 30
    return t("pixels").groupBy("sca").agg(r(P.centroid("x", a)).alias("cx"), r(P.centroid("y", a)).alias("cy"), r(P.centroid("x", a) - P.centroid("x", b)).alias("shift"))


@query("stamp_centroids", "SELECT w, round(avg(c - 31.5), 6) AS shift FROM (SELECT sca, y % 4 AS w, sum(x * value_a) / sum(value_a) AS c FROM {pixels} GROUP BY 1, 2) GROUP BY w")
def stamp_centroids(t):
    c = t("pixels").groupBy("sca", (F.col("y") % 4).alias("w")).agg(P.centroid("x", F.col("value_a")).alias("c"))
    return c.groupBy("w").agg(r(F.avg(F.col("c") - 31.5)).alias("shift"))


@query("grid_bin_floor", "SELECT sca, floor(ysca - 0.5)::INT AS y, floor(xsca - 0.5)::INT AS x, round(sum(mag), 4) AS value FROM {manifest} WHERE floor(ysca - 0.5) BETWEEN 0 AND 4087 AND floor(xsca - 0.5) BETWEEN 0 AND 4087 GROUP BY ALL")
def grid_bin_floor(t):
    pts = t("manifest").select("sca", F.col("xsca").alias("px"), F.col("ysca").alias("py"), F.col("mag").alias("weight"))
    return P.bin_floor(pts, ["sca"], 4088).withColumn("value", r(F.col("value"), 4))


BILIN = "SELECT sca, floor(py - 0.5)::INT + b AS y, floor(px - 0.5)::INT + a AS x, weight * CASE a WHEN 0 THEN 1 - (px - 0.5 - floor(px - 0.5)) ELSE px - 0.5 - floor(px - 0.5) END * CASE b WHEN 0 THEN 1 - (py - 0.5 - floor(py - 0.5)) ELSE py - 0.5 - floor(py - 0.5) END AS v FROM (SELECT sca, xsca AS px, ysca AS py, mag AS weight FROM {manifest}), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) q(a, b)"


@query("grid_bin_bilinear", f"SELECT sca, y, x, round(sum(v), 4) AS value FROM ({BILIN}) WHERE y BETWEEN 0 AND 4087 AND x BETWEEN 0 AND 4087 GROUP BY ALL")
def grid_bin_bilinear(t):
    pts = t("manifest").select("sca", F.col("xsca").alias("px"), F.col("ysca").alias("py"), F.col("mag").alias("weight"))
    return P.bin_bilinear(pts, ["sca"], 4088).withColumn("value", r(F.col("value"), 4))


@query("grid_coadd_mean", "SELECT gy, gx, round(avg(v), 5) AS value, n_img / 18.0 AS coverage FROM (SELECT *, count(DISTINCT sca) OVER (PARTITION BY gy, gx) AS n_img FROM (SELECT sca, round_even(ysca / 512, 0)::INT AS gy, round_even(xsca / 512, 0)::INT AS gx, mag AS v FROM {manifest})) GROUP BY gy, gx, n_img".replace("count(DISTINCT sca) OVER (PARTITION BY gy, gx)", "len(list_distinct(list(sca) OVER (PARTITION BY gy, gx)))"))
def grid_coadd_mean(t):
    """Nearest-cell mean of all detectors on one canvas, with the share of detectors in each cell."""
    at = lambda c: F.rint(F.col(c) / 512).cast("int")
    m = t("manifest").select("sca", at("ysca").alias("gy"), at("xsca").alias("gx"), "mag")
    return m.groupBy("gy", "gx").agg(r(F.avg("mag"), 5).alias("value"), (F.count_distinct("sca") / 18.0).alias("coverage"))


@query("block_mean", "SELECT sca, y // 4 AS by, x // 4 AS bx, round(sum(value_a) / 16, 4) AS value FROM {pixels} GROUP BY ALL")
def block_mean(t):
    """Means of 4 x 4 blocks; absent pixels count 0."""
    return t("pixels").groupBy("sca", F.floor(F.col("y") / 4).cast("int").alias("by"), F.floor(F.col("x") / 4).cast("int").alias("bx")).agg(r(F.sum("value_a") / 16, 4).alias("value"))


@query("flux_extent", "SELECT sca, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM (SELECT *, max(value_a) OVER (PARTITION BY sca) AS peak FROM {pixels}) WHERE value_a > 0.8 * peak GROUP BY sca")
def flux_extent(t):
    p = t("pixels").withColumn("peak", F.max("value_a").over(Window.partitionBy("sca"))).filter(F.col("value_a") > 0.8 * F.col("peak"))
    return p.groupBy("sca").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query("flux_conservation", f"SELECT round((SELECT sum(v) FROM ({BILIN}) WHERE y BETWEEN 0 AND 4087 AND x BETWEEN 0 AND 4087) / sum(mag), 6) AS ratio FROM {{manifest}}")
def flux_conservation(t):
    pts = t("manifest").select("sca", F.col("xsca").alias("px"), F.col("ysca").alias("py"), F.col("mag").alias("weight"))
    out = P.bin_bilinear(pts, ["sca"], 4088).agg(F.sum("value").alias("a"))
    return out.crossJoin(F.broadcast(pts.agg(F.sum("weight").alias("b")))).select(r(F.col("a") / F.col("b")).alias("ratio"))


ODDV = "CASE WHEN (x * 7 + y) % 501 = 0 THEN 'NaN'::DOUBLE WHEN (x * 5 + y) % 701 = 0 THEN 'Infinity'::DOUBLE ELSE value_a END"


@query("nonfinite_report", f"SELECT sca, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (isinf(v)) AS n_inf, min(y) FILTER (isnan(v) OR isinf(v)) AS y0, max(y) FILTER (isnan(v) OR isinf(v)) AS y1 FROM (SELECT sca, y, x, {ODDV} AS v FROM {{pixels}}) GROUP BY sca HAVING count(*) FILTER (isnan(v) OR isinf(v)) > 0")
def nonfinite_report(t):
    v = F.when((F.col("x") * 7 + F.col("y")) % 501 == 0, F.lit(float("nan"))).when((F.col("x") * 5 + F.col("y")) % 701 == 0, F.lit(float("inf"))).otherwise(F.col("value_a"))
    return P.nonfinite_report(t("pixels").withColumn("v", v), ["sca"], "v")


@query("radial_profile", "SELECT bin, round(avg(value_a), 5) AS mean_a, round(avg(abs(value_a - value_b)), 7) AS err FROM (SELECT floor(sqrt(pow(x - 32.0, 2) + pow(y - 32.0, 2)) / 4)::INT AS bin, value_a, value_b FROM {pixels}) WHERE bin < 8 GROUP BY bin")
def radial_profile(t):
    b = F.floor(F.sqrt(F.pow(F.col("x") - 32.0, 2) + F.pow(F.col("y") - 32.0, 2)) / 4).cast("int")
    return t("pixels").withColumn("bin", b).filter("bin < 8").groupBy("bin").agg(r(F.avg("value_a"), 5).alias("mean_a"), r(F.avg(F.abs(F.col("value_a") - F.col("value_b"))), 7).alias("err"))


BRIGHT = f"(SELECT n.*, g.i, 0.9 + g.i * 0.0175 AS wl, abs(g.f) * sens AS counts FROM {NESTED} n JOIN (SELECT catalog_index AS c, sed_index FROM {{sources}}) q ON n.catalog_index = q.c JOIN (SELECT sim, sed_index, i, f FROM {LONG}) g ON n.sim = g.sim AND q.sed_index = g.sed_index JOIN {{sensitivity}} s ON s.sca = n.sca AND s.ord = n.ord AND s.i = g.i WHERE n.type = 'SER')"


def events(t):
    """(source, wavelength) positions with counts. Spectra are exploded last, for the sources that are left."""
    m = nested(t).filter("type = 'SER'").join(t("sources").select("catalog_index", "sim", "sed_index"), "catalog_index")
    df = m.join(galaxies(t), ["sim", "sed_index"]).select("*", F.posexplode("flux").alias("i", "f"))
    df = df.join(F.broadcast(t("sensitivity").select("sca", "ord", "i", "sens")), ["sca", "ord", "i"]).withColumn("wl", 0.9 + F.col("i") * 0.0175)
    px, py = S.trace_position("xf", "yf", "wl")
    return df.select("catalog_index", "sca", "ord", "i", px.alias("px"), py.alias("py"), (F.col("f") * F.col("sens")).alias("weight"))


#: Weights of all events are made once, before positions, so that DuckDB computes a trace once a row.
WEIGHTS = f"""g AS MATERIALIZED (SELECT sim, sed_index, i, abs(f) AS f FROM {LONG}), se AS MATERIALIZED (SELECT sca, ord, i, sens FROM {{sensitivity}}),
src AS MATERIALIZED (SELECT n.*, q.sed_index AS sed FROM {NESTED} n JOIN (SELECT catalog_index AS c, sed_index FROM {{sources}}) q ON n.catalog_index = q.c WHERE n.type = 'SER'),
k AS MATERIALIZED (SELECT catalog_index AS c, g.i, g.f * se.sens AS counts FROM src n JOIN g ON n.sim = g.sim AND n.sed = g.sed_index JOIN se ON se.sca = n.sca AND se.ord = n.ord AND se.i = g.i),
hits AS MATERIALIZED (SELECT catalog_index, px, py, counts FROM {traced_sql("(SELECT src.*, k.counts, 0.9 + k.i * 0.0175 AS wl FROM src JOIN k ON src.catalog_index = k.c)", "wl")})"""


@query("dispersed_events", f"WITH {WEIGHTS} SELECT catalog_index, count(*) AS n, round(min(px), 3) AS x0, round(max(px), 3) AS x1, round(min(py), 3) AS y0, round(max(py), 3) AS y1, round(sum(counts), 4) AS counts FROM hits GROUP BY catalog_index")
def dispersed_events(t):
    """The events of each source: how many, the box they fill, and their counts."""
    e = events(t).groupBy("catalog_index")
    box = [r(f(a), 3).alias(n) for a, names in (("px", ("x0", "x1")), ("py", ("y0", "y1"))) for f, n in zip((F.min, F.max), names, strict=True)]
    return e.agg(F.count("*").alias("n"), *box, r(F.sum("weight"), 4).alias("counts"))


TR = "(SELECT src_group AS src, i, 1 + catalog_index % 18 AS sca, ((i + src_group) % 64)::INT AS ty, i AS tx FROM (SELECT DISTINCT ON (src_group) src_group, catalog_index FROM {sources} ORDER BY src_group, catalog_index), (SELECT unnest(range(0, 64))::INT AS i))"


def traces(t):
    """One trace for each group: the row and column of each of 64 samples."""
    first = t("sources").groupBy("src_group").agg(F.min("catalog_index").alias("c"))
    i = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    df = first.select(F.col("src_group").alias("src"), (1 + F.col("c") % 18).cast("int").alias("sca"), i)
    return df.withColumn("ty", ((F.col("i") + F.col("src")) % 64).cast("int")).withColumn("tx", F.col("i"))


@query("cutout_along_trace", f"SELECT src, i, k, round(coalesce(value_a, 0), 4) AS value FROM {TR} t CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) o(k) LEFT JOIN {{pixels}} p ON p.sca = t.sca AND p.x = t.tx + k AND p.y = t.ty")
def cutout_along_trace(t):
    return P.cutout(traces(t), t("pixels"), 2).select("src", "i", "k", r(F.col("value"), 4).alias("value"))


#: One trace for each source.
ALL_TR = "(SELECT catalog_index AS src, i, (1 + catalog_index % 18)::INT AS sca, ((i + catalog_index) % 64)::INT AS ty, i AS tx FROM {sources}, (SELECT unnest(range(0, 64))::INT AS i))"
EXTRACT = f"SELECT src, i, round(sum(coalesce(value_a, 0)) * 2.5, 4) AS flux FROM {ALL_TR} t CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) o(k) LEFT JOIN {{pixels}} p ON p.sca = t.sca AND p.x = t.tx + k AND p.y = t.ty GROUP BY src, i"


def extracted(t, sources):
    """Spectrum of each source: sums across its trace, looked up in sums made once a place of the image. Rows that share an id add up."""
    c = F.col("catalog_index")
    df = sources.groupBy(c.alias("src")).agg(F.count("*").alias("copies")).withColumn("sca", (1 + F.col("src") % 18).cast("int"))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumns({"y": ((F.col("i") + F.col("src")) % 64).cast("int"), "x": F.col("i")})
    df = df.join(small(P.sums_across(t("pixels"), 2)), ["sca", "y", "x"], "left")
    return df.select("src", "i", r(F.coalesce("total", F.lit(0.0)) * F.col("copies") * 2.5, 4).alias("flux"))


@query("extract_spectrum", EXTRACT)
def extract_spectrum(t):
    return extracted(t, t("sources"))


@query("expected_vs_extracted", f"SELECT src, count(*) AS n, round(quantile_cont(flux - 100 * f, 0.5), 4) AS level FROM ({EXTRACT}) e JOIN {LONG} g ON g.vec_id = e.src AND g.i = e.i GROUP BY src")
def expected_vs_extracted(t):
    """Only sources with a spectrum are extracted; each of these rows finds its own sample in the array."""
    g = small(t("spectra").select(F.col("vec_id").alias("src"), spectra.flux_array("embedding").alias("f")))
    some = t("sources").join(g.select(F.col("src").alias("catalog_index")), "catalog_index", "left_semi")
    e = extracted(t, some).join(g, "src").filter(F.col("i") < F.size("f"))
    return e.groupBy("src").agg(F.count("*").alias("n"), r(F.percentile(F.col("flux") - 100 * F.get("f", F.col("i")), F.lit(0.5)), 4).alias("level"))


#: Lines of all sources on the binned images, 63.9 pixels of a detector to one, counted from 0.
SPOTS = f"(SELECT catalog_index, sca, ord, line_id, x_pred / 63.9::DOUBLE - 0.5 AS x, y_pred / 63.9::DOUBLE - 0.5 AS y FROM ({TRUTH}) WHERE on_detector)"
PROFILES = f"""o AS MATERIALIZED (SELECT *, row_number() OVER () AS id, floor(x + 0.5)::INT AS xc, floor(y + 0.5)::INT AS yc FROM {SPOTS} WHERE floor(x + 0.5) BETWEEN 8 AND 55 AND floor(y + 0.5) BETWEEN 8 AND 55),
px AS MATERIALIZED (SELECT * FROM {{pixels}}), k AS (SELECT unnest(range(-8, 9))::INT AS d),
b AS MATERIALIZED (SELECT o.id, k.d AS dy, p.x - o.xc AS dx, p.value_a AS v FROM o, k, px p WHERE p.sca = o.sca AND p.y = o.yc + k.d AND p.x BETWEEN o.xc - 8 AND o.xc + 8),
sums AS (SELECT 0 AS axis, id, dy AS d, sum(v) AS s FROM b WHERE abs(dx) <= 3 GROUP BY id, dy UNION ALL SELECT 1, id, dx, sum(v) FROM b WHERE abs(dy) <= 3 GROUP BY id, dx),
prof AS MATERIALIZED (SELECT a.axis, o.id, k.d - CASE a.axis WHEN 0 THEN o.y - o.yc ELSE o.x - o.xc END AS t, coalesce(s, 0) AS s FROM o CROSS JOIN k CROSS JOIN (VALUES (0), (1)) a(axis) LEFT JOIN sums u ON u.axis = a.axis AND u.id = o.id AND u.d = k.d)"""


def spots(t):
    at = lambda c: F.col(c) / 63.9 - 0.5
    return line_truth_rows(t).filter("on_detector").select("catalog_index", "sca", "ord", "line_id", at("x_pred").alias("x"), at("y_pred").alias("y"))


@query("measure_lines", f"WITH {PROFILES}, base AS (SELECT axis, id, regr_slope(s, t) AS m, regr_intercept(s, t) AS c FROM prof WHERE abs(t) > 4 GROUP BY 1, 2), e AS (SELECT axis, id, sum(t * e) / sum(e) AS at, sum(e) AS flux FROM (SELECT axis, id, t, greatest(s - m * t - c, 0) AS e FROM prof JOIN base USING (axis, id) WHERE abs(t) <= 4) GROUP BY 1, 2 HAVING sum(e) > 1e-6) SELECT catalog_index, sca, ord, line_id, round(a.at, 4) AS along, round(c.at, 4) AS across, round(a.flux, 3) AS flux FROM o JOIN e a ON a.id = o.id AND a.axis = 0 JOIN e c ON c.id = o.id AND c.axis = 1")
def measure_lines(t):
    """Every line of every source: a box collapsed along and across, linear baseline taken off, centroids from the predicted place."""
    m = P.measure(P.profiles(spots(t), t("pixels"), 64, 8, 3), 8, 4)
    return m.select("catalog_index", "sca", "ord", "line_id", r(F.col("along"), 4).alias("along"), r(F.col("across"), 4).alias("across"), r(F.col("flux"), 3).alias("flux"))


@query("cross_profile_peak", f"WITH {PROFILES} SELECT catalog_index, sca, ord, line_id, round(max(s) / sum(s), 6) AS peak FROM o JOIN prof USING (id) WHERE axis = 1 GROUP BY ALL HAVING sum(s) > 0")
def cross_profile_peak(t):
    """Share of the cross profile's flux in its highest pixel, at every line of every source."""
    p = P.profiles(spots(t), t("pixels"), 64, 8, 3).withColumn("total", P.total(F.col("cols"))).filter("total > 0")
    return p.select("catalog_index", "sca", "ord", "line_id", r(F.array_max("cols") / F.col("total")).alias("peak"))


@query("continuum_budget", "SELECT curve, line_id, round(level, 5) AS level, round(level * amp_rel / sqrt(level * 190 + 100) * 190, 5) AS snr, amp_rel AS contrast, level * (1 + amp_rel) * 190 < 8000 AS fits FROM (SELECT s.curve, l.line_id, l.amp_rel, s.sens * 25 AS level FROM {curves} s JOIN {lines} l ON s.wavelength = l.center_a - l.center_a % 200)")
def continuum_budget(t):
    """Level, signal to noise and full well at each line of a short constant list, for each response."""
    s = t("curves").join(F.broadcast(t("lines")), F.expr("wavelength = center_a - center_a % 200"))
    level = F.col("sens") * 25
    return s.select("curve", "line_id", r(level, 5).alias("level"), r(level * F.col("amp_rel") / F.sqrt(level * 190 + 100) * 190, 5).alias("snr"), F.col("amp_rel").alias("contrast"), (level * (1 + F.col("amp_rel")) * 190 < 8000).alias("fits"))


@query("perf_gate", "SELECT ord, min(ms) FILTER (variant = 'F') AS full_ms, min(ms) FILTER (variant = 'O') AS floor_ms, round(min(ms) FILTER (variant = 'F') / min(ms) FILTER (variant = 'O'), 6) AS ratio, min(ms) FILTER (variant = 'F') / min(ms) FILTER (variant = 'O') <= 1.5 AS passed FROM {bench} GROUP BY ord")
def perf_gate(t):
    p = t("bench").groupBy("ord").pivot("variant", ["F", "O"]).agg(F.min("ms"))
    ratio = F.col("F") / F.col("O")
    return p.select("ord", F.col("F").alias("full_ms"), F.col("O").alias("floor_ms"), r(ratio).alias("ratio"), (ratio <= 1.5).alias("passed"))


@query("bench_stats", "SELECT ord, variant, round(avg(ms), 4) AS mean, round(stddev_pop(ms), 4) AS spread, round(avg(ms) / 1000, 6) AS per_item FROM {bench} GROUP BY 1, 2")
def bench_stats(t):
    return t("bench").groupBy("ord", "variant").agg(r(F.avg("ms"), 4).alias("mean"), r(F.stddev_pop("ms"), 4).alias("spread"), r(F.avg("ms") / 1000).alias("per_item"))


FILLED = "(SELECT *, last_value(CASE WHEN event_type = 'error' THEN sca END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM {log_lines})"


def filled(t):
    """Each log line with the detector of the last header line of its file."""
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t("log_lines").withColumn("header", F.last(F.when(F.col("event_type") == "error", F.col("sca")), ignorenulls=True).over(w))


@query("log_forward_fill", f"SELECT file_id, line_no, header FROM {FILLED} WHERE header IS NOT NULL")
def log_forward_fill(t):
    return filled(t).filter("header is not null").select("file_id", "line_no", "header")


@query("run_totals", f"SELECT file_id, round(sum(value), 3) AS total, round(sum(value) FILTER (event_type = 'click'), 3) AS clicks, max(value) AS most, round(sum(value) / count(*) * 1000, 3) AS per_1000 FROM {FILLED} WHERE header IS NOT NULL GROUP BY file_id HAVING sum(value) FILTER (event_type = 'click') IS NOT NULL")
def run_totals(t):
    d = filled(t).filter("header is not null")
    out = d.groupBy("file_id").agg(r(F.sum("value"), 3).alias("total"), r(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), 3).alias("clicks"), F.max("value").alias("most"), r(F.sum("value") / F.count("*") * 1000, 3).alias("per_1000"))
    return out.filter("clicks is not null")


@query("timing_side_by_side", f"SELECT header AS sca, round(sum(value) FILTER (file_id % 3 = 0), 3) AS run0, round(sum(value) FILTER (file_id % 3 = 1), 3) AS run1, round(sum(value) FILTER (file_id % 3 = 2), 3) AS run2 FROM {FILLED} WHERE header IS NOT NULL GROUP BY header")
def timing_side_by_side(t):
    d = filled(t).filter("header is not null").withColumn("run", F.col("file_id") % 3)
    p = d.groupBy(F.col("header").alias("sca")).pivot("run", [0, 1, 2]).agg(r(F.sum("value"), 3))
    return p.select("sca", *(F.col(str(i)).alias(f"run{i}") for i in range(3)))
