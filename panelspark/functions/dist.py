"""Tails of the usual test distributions, from the incomplete beta and gamma functions."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _gamma_sf(a: float, x: float) -> float:
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-17:
                break
        return max(0.0, 1.0 - front * total)
    b, c = x + 1.0 - a, 1e300
    d = out = 1.0 / b
    for n in range(1, 10_000):
        step = -n * (n - a)
        b += 2.0
        d = 1.0 / (step * d + b)
        c = b + step / c
        out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * out


def t_sf(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * beta_cdf(df / (df + t * t), df / 2.0, 0.5)
    return half if t >= 0 else 1.0 - half


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_cdf(d2 / (d2 + d1 * x), d2 / 2.0, d1 / 2.0)


def chi2_sf(x: float, df: float) -> float:
    return _gamma_sf(df / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if norm_sf(-mid) < p else (low, mid)
    return 0.5 * (low + high)


def binomial_two_sided(hits: int, n: int, p0: float = 0.5) -> float:
    """Exact: the mass of all outcomes that are no more likely than the observed one."""
    mass = [math.comb(n, k) * p0**k * (1 - p0) ** (n - k) for k in range(n + 1)]
    return min(1.0, math.fsum(m for m in mass if m <= mass[hits] * (1 + 1e-7)))


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    t = rho * math.sqrt((n - 2) / ((1.0 + rho) * (1.0 - rho)))
    return 2.0 * t_sf(abs(t), n - 2)


def skew_test(biased_skew: float, n: int) -> tuple[float, float]:
    """D'Agostino's z and its two-sided p."""
    y = biased_skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    kurt = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1.0 + math.sqrt(2.0 * (kurt - 1.0))
    scale = math.sqrt(2.0 / (w2 - 1.0))
    z = math.asinh((y or 1.0) / scale) / math.sqrt(0.5 * math.log(w2))
    return z, 2.0 * norm_sf(abs(z))
