"""Distribution functions that numpy lacks."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, pi, sqrt
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_1_sf(x: float) -> float:
    """Upper tail of chi-squared with 1 degree of freedom."""
    return erfc(sqrt(max(x, 0.0) / 2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(x: float, nu: float) -> float:
    tail = incomplete_beta(nu / 2, 0.5, nu / (nu + x * x)) / 2
    return 1 - tail if x > 0 else tail


def t_quantile(p: float, nu: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        m = (lo + hi) / 2
        lo, hi = (m, hi) if t_cdf(m, nu) < p else (lo, m)
    return (lo + hi) / 2


def t_pdf(x: float, nu: float) -> float:
    return exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi) * (1 + x * x / nu) ** (-(nu + 1) / 2)


def var_es(mean: float, sigma: float, confidence: float, nu: float | None = None) -> tuple[float, float]:
    """Value at risk and expected shortfall of a normal return, or a Student t scaled to variance sigma**2."""
    a = 1 - confidence
    if nu is None:
        z = NormalDist().inv_cdf(confidence)
        return sigma * z - mean, sigma * NormalDist().pdf(z) / a - mean
    scale = sqrt((nu - 2) / nu)
    q = t_quantile(confidence, nu)
    return sigma * scale * q - mean, sigma * scale * t_pdf(q, nu) * (nu + q * q) / (nu - 1) / a - mean
