"""Exact ranks and quantiles without a sort, or all values of a group, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.sky import small
from skyloom.sources.readers import kept

#: Approximate quantiles are off by about one rank in so many.
ACCURACY = 10_000


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's number, from 0, in the order of all rows by ``order`` (ties in any order).

    Rows are dealt to ranges by sampled bounds, sorted within them and written;
    what a range adds is the count of the ranges before. So the one window
    without a partition sees a row a range, whatever the values are.
    """
    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    before = rows_before(placed)
    out = placed.withColumn("_part", F.shiftrightunsigned("_place", 33)).join(small(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_place", "_before")


def rows_before(placed: DataFrame) -> DataFrame:
    """(_part, _before): of each range, the rows in the ranges before."""
    parts = placed.groupBy(F.shiftrightunsigned("_place", 33).alias("_part")).agg(F.count("*").alias("_rows"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_before"))


def ranks(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Adds ``rank`` (from 0, by value then ``tie``) and ``n`` (rows of the group). Null and NaN values are left out.

    All rows are numbered by group, value and tie; a group's ranks start at its smallest number.
    """
    rows = df.withColumn("_v", F.col(value).cast("double")).filter("_v is not null and not isnan(_v)")
    placed = numbered(rows, [*keys, "_v", tie], "_at")
    groups = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    joined = placed.join(small(groups), keys) if keys else placed.crossJoin(F.broadcast(groups))
    return joined.select(*df.columns, (F.col("_at") - F.col("_first")).alias("rank"), "n")


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, shares: list[float], slack: float = 2 / ACCURACY) -> DataFrame:
    """Keys and ``q``: the linear-interpolated quantiles at each share, as an array. Groups without a value are left out.

    A mergeable sketch brackets each quantile; one more pass counts what lies
    below the bracket and each distinct value within it, so only values near a
    quantile are ordered, however the others are spread. The values next to a
    bracket are kept too. A quantile that its bracket misses is looked for
    again, in wider brackets.
    """
    rows = df.select(*keys, value.cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    ends = [min(max(e, 0.0), 1.0) for p in shares for e in (p - slack, p + slack)]
    bounds = kept(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e")))
    met = rows.join(small(bounds), keys) if keys else rows.crossJoin(F.broadcast(bounds))
    low, high = (lambda i: F.col("_e")[2 * i], lambda i: F.col("_e")[2 * i + 1]) if slack < 1 else (lambda i: F.lit(float("-inf")), lambda i: F.lit(float("inf")))
    side = lambda i: F.when(F.col("_v") < low(i), -1).when(F.col("_v") > high(i), 1).otherwise(0)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("share"), side(i).alias("side")) for i, p in enumerate(shares)))).alias("_s")
    met = met.select(*keys, "_n", "_v", each).select(*keys, "_n", "_v", "_s.*")
    group = [*keys, "_n", "i", "share"]
    counts = met.groupBy(*group, "side", F.when(F.col("side") == 0, F.col("_v")).alias("_in")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "i").orderBy("side", "_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_at", F.when(F.col("side") < 0, F.col("_hi")).otherwise(F.col("_lo")))
    first = F.when(F.col("side") < 0, F.col("_before") + F.col("_c") - 1).otherwise(F.col("_before"))
    stop = F.when(F.col("side") > 0, F.col("_before") + 1).otherwise(F.col("_before") + F.col("_c"))
    place = F.col("share") * (F.col("_n") - 1)
    at = lambda rank: F.max(F.when((first <= rank) & (rank < stop), F.col("_at")))
    found = counts.groupBy(*group).agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"))
    found = kept(found.select(*keys, "i", (F.col("_a") + (place - F.floor(place)) * (F.col("_b") - F.col("_a"))).alias("q")))
    if slack < 1 and found.filter("q is null").limit(1).count():
        return exact_quantiles(df, keys, value, shares, max(16 * slack, 2 / ACCURACY))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q")).filter(F.size("q") > 0).select(*keys, F.transform("q", lambda x: x["q"]).alias("q"))


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Keys and the exact median of a column, under ``name``."""
    return exact_quantiles(df, keys, F.col(value), [0.5]).select(*keys, F.col("q")[0].alias(name))
