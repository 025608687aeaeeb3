"""Normal, chi-square and Beta functions in plain Python, for tables of a few rows on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete Beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def beta_ppf(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def jeffreys_interval(events: float, exposure: float, level: float = 0.95) -> tuple[float, float]:
    """Interval of a rate under the Jeffreys prior, Beta(events + 1/2, exposure - events + 1/2); events beyond the exposure count as all of it."""
    tail, rest = (1 - level) / 2, max(exposure - events, 0.0) + 0.5
    return beta_ppf(tail, events + 0.5, rest), beta_ppf(1 - tail, events + 0.5, rest)


def likelihood_ratio(full: float, reduced: float, df: int) -> tuple[float, float]:
    """Statistic and p-value."""
    x = max(0.0, 2 * (full - reduced))
    return x, chi2_sf(x, df)
