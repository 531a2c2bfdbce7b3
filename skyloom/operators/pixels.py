"""Sparse images as rows (image, y, x, value): binning, comparison, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.sky import small
from skyloom.sources.readers import kept


def bin_floor(points: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Sum of weights per pixel; array index is floor(x - 0.5), what falls outside is dropped."""
    at = lambda c: F.floor(F.col(c) - 0.5).cast("int")
    df = points.withColumns({"y": at("py"), "x": at("px")}).filter(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1))
    return df.groupBy(*keys, "y", "x").agg(F.sum("weight").alias("value"))


def bin_bilinear(points: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Each weight split over four neighbours, shifted by half a pixel before weighting: 6.0 splits evenly, 5.5 lands whole."""
    base = {"fx": F.floor(F.col("px") - 0.5), "fy": F.floor(F.col("py") - 0.5)}
    df = points.withColumns(base).withColumns({"u": F.col("px") - 0.5 - F.col("fx"), "v": F.col("py") - 0.5 - F.col("fy")})
    part = lambda a, b: F.struct((F.col("fy") + b).cast("int").alias("y"), (F.col("fx") + a).cast("int").alias("x"), (F.col("weight") * (F.col("u") if a else 1 - F.col("u")) * (F.col("v") if b else 1 - F.col("v"))).alias("w"))
    df = df.select(*keys, F.explode(F.array(part(0, 0), part(0, 1), part(1, 0), part(1, 1))).alias("p")).select(*keys, "p.*")
    inside = F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)
    return df.filter(inside).groupBy(*keys, "y", "x").agg(F.sum("w").alias("value"))


def image_diff(a: DataFrame, b: DataFrame, keys: list[str], rtol: float, atol: float) -> DataFrame:
    """Totals and differences per image; a pixel that one side lacks counts 0. One pass over the union of both."""
    one = a.select(*keys, "y", "x", F.col("value").alias("a"), F.lit(0.0).alias("b"))
    two = b.select(*keys, "y", "x", F.lit(0.0).alias("a"), F.col("value").alias("b"))
    d = one.unionByName(two).groupBy(*keys, "y", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    diff = F.abs(F.col("b") - F.col("a"))
    return d.groupBy(*keys).agg(F.round(F.sum("a"), 3).alias("total"), F.round((F.sum("b") - F.sum("a")) / F.sum("a"), 9).alias("rel"), F.round(F.max(diff), 6).alias("worst"), F.count_if(diff > atol + rtol * F.abs("a")).alias("failing"))


def centroid(axis: str, value: Column) -> Column:
    """Flux-weighted mean position, negatives clipped; NaN without flux."""
    w = F.greatest(value, F.lit(0.0))
    return F.when(F.sum(w) > 0, F.sum(F.col(axis) * w) / F.sum(w)).otherwise(F.lit(float("nan")))


def nonfinite_report(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    inf = F.abs(v) == float("inf")
    bad = F.isnan(v) | inf
    out = pixels.groupBy(*keys).agg(F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(inf).alias("n_inf"), F.min(F.when(bad, F.col("y"))).alias("y0"), F.max(F.when(bad, F.col("y"))).alias("y1"))
    return out.filter("n_nan + n_inf > 0")


def cutout(trace: DataFrame, pixels: DataFrame, half: int, value: str = "value_a") -> DataFrame:
    """Aligned (2 half + 1) values across each sample of a trace (sca, tx, ty); absent pixels are 0."""
    k = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    at = trace.withColumn("k", k).withColumns({"x": F.col("tx") + F.col("k"), "y": F.col("ty")})
    return at.join(pixels.select("sca", "y", "x", F.col(value).alias("_v")), ["sca", "y", "x"], "left").withColumn("value", F.coalesce("_v", F.lit(0.0)))


def sums_across(pixels: DataFrame, half: int, value: str = "value_a") -> DataFrame:
    """(sca, y, x, total): at each place, the sum of the (2 half + 1) values across; places without a pixel among these are absent.

    At most (2 half + 1) rows a pixel, however many traces run over the image; written, as each trace reads it.
    """
    x = F.explode(F.sequence(F.col("x") - half, F.col("x") + half)).alias("x")
    return kept(pixels.select("sca", "y", F.col(value).alias("_v"), x).groupBy("sca", "y", "x").agg(F.sum("_v").alias("total")))


def tiles(pixels: DataFrame, size: int, halo: int, value: str = "value_a") -> DataFrame:
    """(sca, ty, tx, rows): dense tiles of ``size`` pixels with a halo around, as arrays of rows; absent pixels are 0, tiles without pixels absent.

    A pixel goes to the few tiles whose halo holds it; pixels given twice are
    summed. All groupings keep the tile's partitioning, so there is one shuffle.
    """
    wide = size + 2 * halo
    over = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size).cast("int"), F.floor((F.col(c) + halo) / size).cast("int")))
    df = pixels.select("sca", "y", "x", F.col(value).cast("double").alias("v"), over("y").alias("ty")).withColumn("tx", over("x")).repartition("sca", "ty", "tx")
    df = df.select("sca", "ty", "tx", (F.col("y") - F.col("ty") * size + halo).alias("ly"), (F.col("x") - F.col("tx") * size + halo).alias("lx"), "v")
    keys = ["sca", "ty", "tx"]
    filled = lambda at, v, none: F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.struct(at, v))), i), none))
    rows = df.groupBy(*keys, "ly", "lx").agg(F.sum("v").alias("v")).groupBy(*keys, "ly").agg(filled("lx", "v", F.lit(0.0)).alias("row"))
    return rows.groupBy(*keys).agg(filled("ly", "row", F.array_repeat(F.lit(0.0), wide)).alias("rows"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def profiles(places: DataFrame, pixels: DataFrame, image: int, half: int, narrow: int, size: int = 16) -> DataFrame:
    """``places`` (sca, y, x as fractions of pixels, and columns of their own) with their box's profiles over rows and over columns.

    ``rows`` sums, for each of the 2 half + 1 rows of a box, the 2 narrow + 1
    middle columns; ``cols`` the other way round. A place joins one tile, which
    holds its whole box. Boxes that leave the image, or whose tile and halo
    have no pixel at all, are dropped: nothing can be measured there.
    """
    mid = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    inside = lambda c: c.between(half, image - 1 - half)
    # Exploded, so that no filter repeats what places are made of further down the plan.
    spot = F.filter(F.array(F.struct(mid("y").alias("_yc"), mid("x").alias("_xc"))), lambda c: inside(c["_yc"]) & inside(c["_xc"]))
    p = places.withColumn("_spot", F.explode(spot)).select(*places.columns, "_spot.*")
    p = p.withColumns({"ty": F.floor(F.col("_yc") / size).cast("int"), "tx": F.floor(F.col("_xc") / size).cast("int")})
    box = p.join(tiles(pixels, size, half).withColumnRenamed("rows", "_tile"), ["sca", "ty", "tx"])
    part = lambda a, start, n: F.slice(a, start, F.lit(n))
    first = lambda at, tile: F.col(at) - F.col(tile) * size + 1
    down = F.transform(part(F.col("_tile"), first("_yc", "ty"), 2 * half + 1), lambda row: total(part(row, first("_xc", "tx") + half - narrow, 2 * narrow + 1)))
    middle = F.transform(part(F.col("_tile"), first("_yc", "ty") + half - narrow, 2 * narrow + 1), lambda row: part(row, first("_xc", "tx"), 2 * half + 1))
    beside = F.aggregate(middle, F.array_repeat(F.lit(0.0), 2 * half + 1), lambda a, row: F.zip_with(a, row, lambda u, v: u + v))
    return box.select(*places.columns, (F.col("y") - F.col("_yc")).alias("_fy"), (F.col("x") - F.col("_xc")).alias("_fx"), down.alias("rows"), beside.alias("cols"))


def above_baseline(profile: str, shift: str, half: int, core: int) -> Column:
    """(w, tw): flux within ``core`` of the predicted place above a linear baseline fitted to what lies outside, and its sum weighted by place."""
    once = lambda value, f: F.transform(F.array(value), f)[0]
    zeros = lambda *names: F.struct(*(F.lit(0.0).alias(n) for n in names))
    points = F.transform(F.col(profile), lambda s, i: F.struct((i - half - F.col(shift)).alias("t"), s.alias("s")))

    def fitted(a: Column, p: Column) -> Column:
        more = {"n": F.lit(1.0), "t": p["t"], "tt": p["t"] * p["t"], "s": p["s"], "ts": p["t"] * p["s"]}
        return F.when(F.abs(p["t"]) > core, F.struct(*((a[k] + v).alias(k) for k, v in more.items()))).otherwise(a)

    def line(b: Column) -> Column:
        slope = (b["n"] * b["ts"] - b["t"] * b["s"]) / (b["n"] * b["tt"] - b["t"] * b["t"])
        return once(slope, lambda m: F.struct(m.alias("m"), ((b["s"] - m * b["t"]) / b["n"]).alias("c")))

    def excess(pts: Column, b: Column) -> Column:
        over = F.transform(F.filter(pts, lambda p: F.abs(p["t"]) <= core), lambda p: F.struct(p["t"].alias("t"), F.greatest(p["s"] - b["m"] * p["t"] - b["c"], F.lit(0.0)).alias("e")))
        return F.aggregate(over, zeros("w", "tw"), lambda a, p: F.struct((a["w"] + p["e"]).alias("w"), (a["tw"] + p["t"] * p["e"]).alias("tw")))

    return once(points, lambda pts: once(F.aggregate(pts, zeros("n", "t", "tt", "s", "ts"), fitted), lambda sums: once(line(sums), lambda b: excess(pts, b))))


def measure(boxes: DataFrame, half: int, core: int) -> DataFrame:
    """Of :func:`profiles`: centroids along (rows) and across (columns) the dispersion, as residuals from the predicted place, and the line's flux.

    Places without flux above the baseline, on either axis, are dropped.
    """
    both = F.struct(above_baseline("rows", "_fy", half, core).alias("a"), above_baseline("cols", "_fx", half, core).alias("c"))
    # Exploded, so that no filter repeats the work further down the plan.
    e = boxes.withColumn("_m", F.explode(F.filter(F.array(both), lambda m: (m["a"]["w"] > 1e-6) & (m["c"]["w"] > 1e-6))))
    return e.withColumns({"along": F.expr("_m.a.tw / _m.a.w"), "across": F.expr("_m.c.tw / _m.c.w"), "flux": F.col("_m.a.w")}).drop("_m", "_fy", "_fx", "rows", "cols")
