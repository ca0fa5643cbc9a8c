"""Quantiles of Student's t and of F, by bisection on the regularised incomplete beta function."""

from __future__ import annotations

import math


def incomplete_beta(x: float, a: float, b: float) -> float:
    """By its continued fraction, taken from the side on which it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    h = d = 1 / (1 - (a + b) * x / (a + 1))
    c = 1.0
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h / a


def _bisect(below, high: float) -> float:
    low = 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) else (low, mid)
    return (low + high) / 2


def student_t(p: float, df: float) -> float:
    """Quantile for p of at least one half."""
    return _bisect(lambda t: 1 - incomplete_beta(df / (df + t * t), df / 2, 0.5) / 2 < p, 1e4)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _bisect(lambda x: incomplete_beta(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) < p, 1e6)
