"""p-values for finished test statistics (a few hundred result rows, never the data)."""

from __future__ import annotations

import math


def chi2_sf_1df(statistic: float) -> float:
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2.0))


def chi2_sf(statistic: float, df: int) -> float:
    """Upper tail of chi-squared for whole degrees of freedom, by the closed recurrences."""
    half = max(statistic, 0.0) / 2.0
    if df % 2:
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
        steps = (df - 1) // 2
        for step in range(steps):
            total += term
            term *= half / (1.5 + step)
        return total
    total, term = 0.0, math.exp(-half)
    for step in range(df // 2):
        total += term
        term *= half / (step + 1)
    return total


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def f_sf(statistic: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    if not statistic > 0.0:
        return 1.0
    return beta_cdf(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * statistic))
