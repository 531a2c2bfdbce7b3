"""Checks of catalogs and layouts, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.quantiles import numbered


def count_checks(df: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """(issue, n): rows that fail each condition; one aggregation for all."""
    one = df.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in checks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("issue"), F.col(n).alias("n")) for n, _ in checks))).alias("x")).select("x.*")


def column_differences(a: DataFrame, b: DataFrame, key: str, columns) -> DataFrame:
    """(col, differ): rows with the same key that differ in a column; nulls equal nulls, NaN equals NaN."""
    joined = a.join(b.select(key, *(F.col(c).alias(f"{c}_b") for c in columns)), key)
    one = joined.agg(*(F.count_if(~F.col(c).eqNullSafe(F.col(f"{c}_b"))).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("differ")) for c in columns))).alias("x")).select("x.*")


def counts_agree(planned: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Counts per key on both sides, 0 where absent, and whether they agree."""
    both = planned.join(stored, key, "full").na.fill(0, ["planned", "stored"])
    return both.select(key, "planned", "stored", (F.col("planned") == F.col("stored")).alias("ok"))


def row_ids(df: DataFrame, key: str) -> DataFrame:
    """``row_id``: the row's number in order of a key of any spread, from 0, without sorting all rows in one task."""
    return numbered(df, [key], "row_id")


def campaigns(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New minus old of each value, for keys that both hold. Tables bucketed by the keys (``readers.bucketed``) meet without a shuffle."""
    a, b = (df.select(*keys, *(F.col(v).alias(f"{v}_{s}") for v in values)) for df, s in ((old, "old"), (new, "new")))
    return a.hint("merge").join(b, keys).select(*keys, *((F.col(f"{v}_new") - F.col(f"{v}_old")).alias(v) for v in values))
