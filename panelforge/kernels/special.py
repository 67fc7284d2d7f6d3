"""Distribution tails and special functions that NumPy lacks."""

from __future__ import annotations

import math

import numpy as np


def _gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def chi2_sf(x: float, df: float) -> float:
    """P(X > x) for a chi-squared variable."""
    return float("nan") if math.isnan(x) else _gamma_tail(df / 2, max(x, 0.0) / 2)


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """The normal quantile, by bisection of norm_sf."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - norm_sf(mid) < p else (low, mid)
    return (low + high) / 2


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def norm_logpdf(x, mean, sd):
    """Log density of a normal variable; the deviation is kept from 0."""
    sd = np.maximum(sd, 1e-10)
    return -0.5 * np.log(2 * np.pi) - np.log(sd) - 0.5 * ((np.asarray(x, float) - mean) / sd) ** 2


def inverse_gamma_logpdf(x, shape: float, scale: float):
    """Log density of an inverse gamma variable; x is kept from 0."""
    x = np.maximum(np.asarray(x, float), 1e-10)
    return shape * math.log(scale) - math.lgamma(shape) - (shape + 1) * np.log(x) - scale / x
