"""Spectra as array columns: lookup, cleaning, synthetic photometry, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.sky import small


def flux_array(embedding) -> Column:
    """Spectra of the test views: absolute values, in units of 1e-15."""
    return F.transform(embedding, lambda x: F.abs(x.cast("double")))


def sed_lookup(sources: DataFrame, stars: DataFrame, galaxies: DataFrame) -> DataFrame:
    """Spectrum of each source: stars by sed_index, galaxies by (sim, sed_index), times flux_scale. Sources without one are left out."""
    scaled = F.transform("flux", lambda f: f * F.col("flux_scale")).alias("flux")
    star = sources.filter("type = 'PSF'").join(small(stars), "sed_index").select("catalog_index", scaled)
    galaxy = sources.filter("type = 'SER'").join(galaxies, ["sim", "sed_index"]).select("catalog_index", scaled)
    return star.unionByName(galaxy)


def gradient(df: DataFrame, keys: list[str], x: str, y: str | None = None) -> DataFrame:
    """``dx`` (of x over the row number) along a curve: central inside, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(x)
    v = F.col(y or x)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return df.withColumn("grad", F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2))


def weighted_mean(flux: Column, weights: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    return total(F.zip_with(flux, weights, lambda f, w: f * w)) / total(weights)


def segments(curve: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Each sample of a curve with the next: x0, y0, x1, y1 (null after the last), and the ends of the curve."""
    w = Window.partitionBy(*keys).orderBy(x)
    ends = Window.partitionBy(*keys)
    return curve.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.min(x).over(ends).alias("lo"), F.max(x).over(ends).alias("hi"))


def interp_join(points: DataFrame, curve: DataFrame, keys: list[str], at: str, x: str = "x", y: str = "y") -> DataFrame:
    """points with ``value``: linear interpolation of their key's curve, clamped at both ends. Keys without a curve are left out.

    A curve's range is cut into as many bins as it has samples. Segments stand
    in the bins they touch, points in one, so a point meets few segments by
    equi-join, however many samples there are.
    """
    ends = curve.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("bins"))
    place = lambda v: F.coalesce(F.least(F.floor((v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.col("bins")), F.col("bins") - 1), F.lit(0))
    both = lambda a, b: a.join(b, keys) if keys else a.crossJoin(b)
    s = both(segments(curve, keys, x, y).drop("lo", "hi"), small(ends))
    s = s.select(*keys, "x0", "y0", "x1", "y1", F.explode(F.sequence(place(F.col("x0")), place(F.coalesce("x1", "x0")))).alias("bin"))
    p = both(points, small(ends)).withColumn("p", F.least(F.greatest(F.col(at), F.col("lo")), F.col("hi")))
    p = p.withColumn("bin", place(F.col("p")))
    inside = (F.col("p") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("p") < F.col("x1")))
    value = F.when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("p") - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return p.join(small(s), [*keys, "bin"]).filter(inside).withColumn("value", value).select(*points.columns, "value")


def scrub(flux: Column, limit: float) -> Column:
    """Bins that are not finite or too large become 0."""
    return F.transform(flux, lambda f: F.when(F.isnan(f) | f.isNull() | (F.abs(f) > limit), F.lit(0.0)).otherwise(f))


def trapezoid(df: DataFrame, keys: list[str], x: str, y: str, name: str) -> DataFrame:
    """Integral of y over x per key."""
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2
    return df.select(*keys, part.alias("_p")).groupBy(*keys).agg(F.sum("_p").alias(name))
