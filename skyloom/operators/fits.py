"""Least squares by sums of normal equations per group, solved by column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_equations(features: Column, size: int, value: Column, ridge: float = 0.0) -> Column:
    """Aggregate: rows [A | b] of the system for the weights of an array of features. Only ``size`` squared sums are shuffled."""
    once = {(i, j): F.sum(features[i] * features[j]) for i in range(size) for j in range(i, size)}
    entry = lambda i, j: once[min(i, j), max(i, j)] + (ridge if i == j else 0.0)
    return F.array(*(F.array(*(entry(i, j) for j in range(size)), F.sum(features[i] * value)) for i in range(size)))


def solved(system: Column, size: int) -> Column:
    """Weights of a positive definite system [A | b], by elimination of one column a step. Null if a pivot is 0 or null."""

    def step(m: Column, k: Column) -> Column:
        scaled = F.transform(m[k], lambda v: F.try_divide(v, m[k][k]))
        return F.transform(m, lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda v, p: v - row[k] * p)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), system, step), lambda row: row[size])
