"""Joins on the sky: cones, nearest neighbours, isolation, all through zones and an exact filter."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import haversine, require_double
from skyloom.sources.readers import kept

#: Up to so many rows of a small side are sent to every task; beyond, the join shuffles.
FEW = 200_000

#: A search for nearest rows starts where a cell that holds any row that searches has at most so many to be found, on average.
CROWD = 64


def small(df: DataFrame) -> DataFrame:
    """Broadcast if few rows, by count; else never, as Spark's estimate from file sizes doesn't see what a plan repeats or computes."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


def cone_search(df: DataFrame, ra0: float, dec0: float, radius: float) -> DataFrame:
    """Rows within a radius (degrees, inclusive); the band of declinations comes first and reaches the scan."""
    require_double(df, "ra", "dec")
    band = F.col("dec").between(dec0 - radius - 1e-9, dec0 + radius + 1e-9)
    return df.filter(band & (haversine("ra", "dec", ra0, dec0) <= radius))


def zone(dec: Column, height: float) -> Column:
    return F.floor((dec + 90) / height)


def ra_cell(ra: Column, width: float) -> Column:
    """Cells of right ascension, the same on both sides of 0/360."""
    return F.floor(F.pmod(ra, F.lit(360.0)) / width)


def around(df: DataFrame, ra: str, dec: str, radius: float, width: float) -> DataFrame:
    """Each row once for every (zone, ra cell) its circle touches; near a pole, for every ra cell."""
    cells = int(math.ceil(360 / width - 1e-9))
    edge = F.abs(F.col(dec)) + radius
    half = F.when(edge < 89.9, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(radius))) / F.cos(F.radians(edge))))) * 1.001 + 1e-9).otherwise(F.lit(180.0))
    low, high = F.floor((F.pmod(F.col(ra), F.lit(360.0)) - half) / width), F.floor((F.pmod(F.col(ra), F.lit(360.0)) + half) / width)
    span = F.when(high - low >= cells - 1, F.sequence(F.lit(0), F.lit(cells - 1))).otherwise(F.array_distinct(F.transform(F.sequence(low, high), lambda c: F.pmod(c, F.lit(cells)).cast("int"))))
    zones = F.sequence(zone(F.col(dec) - radius - 1e-9, radius), zone(F.col(dec) + radius + 1e-9, radius))
    return df.withColumn("zone", F.explode(zones)).withColumn("cell", F.explode(span))


def cone_join(sources: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """Every (source, centre) within a radius in degrees; centres have ra0, dec0. Only centres are repeated, so no pair comes twice."""
    require_double(sources, "ra", "dec")
    width = max(radius, 0.01)
    width = 360 / math.floor(360 / width)
    right = around(centers, "ra0", "dec0", radius, width)
    left = sources.withColumn("zone", zone(F.col("dec"), radius)).withColumn("cell", ra_cell(F.col("ra"), width).cast("int"))
    return left.join(small(right), ["zone", "cell"]).withColumn("sep", haversine("ra", "dec", "ra0", "dec0")).filter(F.col("sep") <= radius).drop("zone", "cell")


def uncrowded(a: DataFrame, b: DataFrame, at_a: tuple[str, str], at_b: tuple[str, str], radius: float) -> float:
    """A radius, at most the given one, whose square cells hold few rows of b on average over the rows of a that share a cell with any."""
    for _ in range(20):
        count = lambda df, at, n: df.groupBy(*(F.floor(F.col(c) / radius).alias(f"_{i}") for i, c in enumerate(at))).agg(F.count("*").alias(n))  # noqa: E731, B023
        both = count(a, at_a, "m").join(count(b, at_b, "n").hint("merge"), ["_0", "_1"])
        crowd = both.agg(F.sum(F.col("m").cast("double") * F.col("n")) / F.sum("m")).first()[0] or 0.0
        if crowd <= CROWD:
            break
        radius *= math.sqrt(CROWD / 4 / crowd)
    return radius


def nearest_match(targets: DataFrame, catalog: DataFrame, key: str, start: float = 0.02) -> DataFrame:
    """Nearest catalog row of each target (ra0, dec0), with its separation in arcsec and whether that is within one.

    Rows at the same place are searched for, and found, once. The search radius
    starts where the catalog is not crowded and grows eightfold, up to the whole
    sky, for places not yet matched; what a round finds and leaves is written, so
    that no round repeats those before. Ties go to the smallest catalog id. An
    empty catalog matches none.
    """
    require_double(catalog, "ra", "dec")
    place = ["ra0", "dec0"]
    unique = kept(catalog.groupBy("ra", "dec").agg(F.min("catalog_index").alias("catalog_index")))
    left = kept(targets.select(*place).distinct())
    found, radius = [], uncrowded(left, unique, ("ra0", "dec0"), ("ra", "dec"), start)
    while True:
        best = kept(cone_join(unique, left, radius).groupBy(*place).agg(F.min(F.struct("sep", "catalog_index")).alias("m")))
        found.append(best)
        if radius == 180.0:
            break
        left = kept(left.join(small(best.select(*place)), place, "left_anti"))
        if left.isEmpty():
            break
        radius = min(radius * 8, 180.0)
    all_found = targets.join(small(reduce(DataFrame.union, found)), place).groupBy(key).agg(F.min("m").alias("m"))
    return all_found.select(key, "m.catalog_index", (F.col("m.sep") * 3600).alias("sep_arcsec"), (F.col("m.sep") * 3600 <= 1).alias("good"))


def pairs_within(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Every row of a (ra_a, dec_a) with every row of b (ra_b, dec_b) within a flat separation ``d`` in degrees.

    Cells are zones of declination cut in right ascension, wide enough in each
    zone that a row of b is needed in three cells of three zones only.
    """
    z = lambda c: F.floor(F.col(c) / tolerance)
    edge = F.greatest(F.abs("zone"), F.abs(F.col("zone") + 1)) * tolerance
    width = F.least(F.lit(360.0), tolerance * 1.000001 / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-9)))
    cell = lambda c: F.floor(F.col(c) / F.col("width"))
    right = b.withColumn("zone", F.explode(F.sequence(z("dec_b") - 1, z("dec_b") + 1))).withColumn("width", width)
    right = right.withColumn("cell", F.explode(F.sequence(cell("ra_b") - 1, cell("ra_b") + 1))).drop("width")
    pairs = a.withColumn("zone", z("dec_a")).withColumn("width", width).withColumn("cell", cell("ra_a")).drop("width").join(small(right), ["zone", "cell"])
    d = F.sqrt(F.pow((F.col("ra_a") - F.col("ra_b")) * F.cos(F.radians("dec_a")), 2) + F.pow(F.col("dec_a") - F.col("dec_b"), 2))
    return pairs.drop("zone", "cell").withColumn("d", d).filter(F.col("d") <= tolerance)


def nearest_within(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Nearest row of b (id_b, ra_b, dec_b) of each row of a (id_a, ra_a, dec_a) by flat separation in degrees, if within a tolerance.

    Rows at the same place are searched for, and found, once. The search starts
    within a radius where b is not crowded, and grows eightfold, up to the
    tolerance, for places not yet matched. Ties go to the smallest id.
    """
    place = ["ra_a", "dec_a"]
    unique = kept(b.groupBy("ra_b", "dec_b").agg(F.min("id_b").alias("id_b")))
    left = kept(a.select(*place).distinct())
    found, radius = [], uncrowded(left, unique, ("ra_a", "dec_a"), ("ra_b", "dec_b"), tolerance)
    while True:
        best = kept(pairs_within(left, unique, radius).groupBy(*place).agg(F.min(F.struct("d", "id_b")).alias("m")))
        found.append(best)
        if radius == tolerance:
            break
        left = kept(left.join(small(best.select(*place)), place, "left_anti"))
        if left.isEmpty():
            break
        radius = min(radius * 8, tolerance)
    all_found = a.select("id_a", *place).join(small(reduce(DataFrame.union, found)), place)
    return all_found.groupBy("id_a").agg(F.min("m").alias("m")).select("id_a", "m.id_b", "m.d")


def without_neighbour(left: DataFrame, df: DataFrame, radius: float, beats: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Rows of ``left`` that have no other row of ``df`` of the same detector and order within a radius.

    Rows of a small cell all lie within the radius, so its smallest and largest
    id (with ``beats``, its brightest row) rule out nearly all others without a
    search. What is left, about a row for each small cell however crowded it
    is, goes to the nine cells of a grid around, where the join stops at a first
    neighbour. ``beats`` says of a neighbour's mag and id whether it counts,
    against columns mag and id.
    """
    cell = lambda c, size: F.floor(F.least(F.greatest(F.col(c) / size, F.lit(-1e15)), F.lit(1e15)))
    place = ["sca", "ord", "gx", "gy"]
    one = left.withColumn("id", F.col("catalog_index"))
    two = df.select("sca", "ord", F.col("catalog_index").alias("other"), F.col("mag").alias("mag2"), F.col("xsca").alias("x2"), F.col("ysca").alias("y2"))

    side = radius / 1.5
    near_zero = (F.abs("x2") < 1e9 * radius) & (F.abs("y2") < 1e9 * radius)
    fine = two.filter(near_zero).groupBy("sca", "ord", cell("x2", side).alias("gx"), cell("y2", side).alias("gy"))
    if beats is None:
        fine, out = fine.agg(F.min("other").alias("lo"), F.max("other").alias("hi")), (F.col("id") != F.col("lo")) | (F.col("id") != F.col("hi"))
    else:
        fine, out = fine.agg(F.min(F.struct("mag2", "other")).alias("top")), (F.col("id") != F.col("top.other")) & beats(F.col("top.mag2"), F.col("top.other"))
    one = one.withColumns({"gx": cell("xsca", side), "gy": cell("ysca", side)})
    on = [*(one[k] == fine[k] for k in place), out]
    rest = kept(one.join(fine.hint("merge"), reduce(lambda x, y: x & y, on), "left_anti").select(*left.columns).withColumn("_row", F.monotonically_increasing_id()))

    nine = lambda c: F.explode(F.sequence(cell(c, radius) - 1, cell(c, radius) + 1))
    spread = rest.withColumn("id", F.col("catalog_index")).withColumn("gx", nine("xsca")).withColumn("gy", nine("ysca"))
    two = two.withColumns({"gx": cell("x2", radius), "gy": cell("y2", radius)})
    close = (F.col("id") != F.col("other")) & (F.hypot(F.col("xsca") - F.col("x2"), F.col("ysca") - F.col("y2")) <= radius)
    on = [*(spread[k] == two[k] for k in place), close, *([beats(F.col("mag2"), F.col("other"))] if beats else [])]
    met = spread.join(two.hint("merge"), reduce(lambda x, y: x & y, on), "left_semi").select("_row").distinct()
    return rest.join(met.hint("merge"), "_row", "left_anti").select(*left.columns)


def isolated_sources(df: DataFrame, radius: float, halvings: int = 4) -> DataFrame:
    """Sources with no neighbour of their order within the largest radius of a halving ladder at which any is isolated, with that radius.

    The ladder is climbed from its smallest radius; a row with a neighbour there is out for all others.
    """
    rows = df.select("catalog_index", "sca", "ord", "xsca", "ysca", "mag")
    alive, found = rows, []
    for k in range(halvings - 1, -1, -1):
        alive = kept(without_neighbour(alive, rows, radius / 2**k))
        found.append(alive.select("catalog_index", "sca", "ord", F.lit(radius / 2**k).alias("radius")))
        if alive.isEmpty():
            break
    levels = reduce(DataFrame.union, found)
    top = levels.groupBy("ord").agg(F.max("radius").alias("radius"))
    return levels.join(F.broadcast(top), ["ord", "radius"]).select("catalog_index", "sca", "ord", "radius")


def separated_top_n(df: DataFrame, n: int, radius: float) -> DataFrame:
    """The n brightest of a greedy pick: in order of brightness, a source stays if none that stays lies within the radius.

    Detectors and orders are apart. Each round picks all sources that have no
    brighter one left within the radius, and drops those near a pick: the greedy
    pick, in parallel. What is fainter than n picks cannot be among them and
    goes too. Ties go to the smaller id; rows that share an id do not exclude
    each other; sources without a magnitude are left out, and those without a
    place have no neighbours.
    """
    columns = ["catalog_index", "sca", "ord", "xsca", "ysca", "mag"]
    alive = kept(df.select(*columns).filter("mag is not null"))
    brighter = lambda mag, other: (mag < F.col("mag")) | ((mag == F.col("mag")) & (other < F.col("id")))
    picked: list[DataFrame] = []
    while True:
        free = kept(without_neighbour(alive, alive, radius, brighter))
        if picked and free.isEmpty():
            break
        picked.append(free)
        best = reduce(DataFrame.union, picked).orderBy("mag", "catalog_index").limit(n)
        end = best.agg(F.count("*").alias("n"), F.max("mag").alias("mag")).first()
        same = reduce(lambda x, y: x & y, [alive[c].eqNullSafe(free[c]) for c in columns])
        left = without_neighbour(alive.join(free, same, "left_anti"), free, radius)
        alive = kept(left if end["n"] < n else left.filter(F.col("mag") <= end["mag"]))
    return best.select("catalog_index", "mag")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
