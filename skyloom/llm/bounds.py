"""Exact binomial bounds."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction; its terms grow with the root of a + b, not with a + b."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, h, c, d, m = 1e-300, 1.0, 1.0, 0.0, 0
    while True:
        # Term 0 is 1; odd and even terms of the fraction alternate after it.
        half = m // 2
        if m == 0:
            term = 1.0
        elif m % 2 == 0:
            term = half * (b - half) * x / ((a + m - 1) * (a + m))
        else:
            term = -(a + half) * (a + b + half) * x / ((a + m - 1) * (a + m))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        h *= c * d
        m += 1
        if abs(c * d - 1) < 1e-14:
            return front * (h - 1)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n or p <= 0:
        return 1.0
    return incomplete_beta(n - k, k + 1, 1 - p)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: with probability 1 - delta the rate behind k of n is below this."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high
