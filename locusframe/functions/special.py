"""Distribution functions in NumPy, for what has no closed column expression. Accurate into far tails by logarithms."""

from __future__ import annotations

from math import erfc as _erfc
from math import lgamma, log

import numpy as np

_STEPS = 300


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lgamma, otypes=[float])(x)


def log_beta_inc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Logarithm of the regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    x = np.asarray(x, float)
    out = np.full(x.shape, -np.inf)
    out[x >= 1] = 0.0
    inside = (x > 0) & (x < 1)
    direct = inside & (x <= (a + 1) / (a + b + 2))
    out[direct] = _log_fraction(a, b, x[direct])
    other = inside & ~direct
    out[other] = np.log1p(-np.exp(_log_fraction(b, a, 1 - x[other])))
    return out


def _log_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    tiny = 1e-300
    front = a * np.log(x) + b * np.log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b) - log(a)
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, _STEPS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return front + np.log(h)


def t_two_sided(t: np.ndarray, df: float) -> np.ndarray:
    """P(|T| >= |t|), not below 1e-300."""
    t = np.asarray(t, float)
    return np.clip(np.exp(log_beta_inc(df / 2, 0.5, df / (df + t * t))), 1e-300, 1.0)


def f_sf(f: np.ndarray, d1: float, d2: float) -> np.ndarray:
    f = np.asarray(f, float)
    return np.clip(np.exp(log_beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))), 1e-300, 1.0)


def t_ppf_upper(alpha: float, df: float) -> float:
    """The value that T exceeds with probability alpha, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(np.array([high]), df)[0] / 2 > alpha:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(np.array([mid]), df)[0] / 2 > alpha else (low, mid)
    return (low + high) / 2


def erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(_erfc, otypes=[float])(x)


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, float) / np.sqrt(2))


def chi2_1_sf(x: np.ndarray) -> np.ndarray:
    return np.clip(erfc(np.sqrt(np.maximum(np.asarray(x, float), 0) / 2)), 1e-300, 1.0)


def nct_cdf(t: float, df: float, shift: float, nodes: int = 200) -> float:
    """Noncentral t: the normal distribution function averaged over the chi distribution of the scale."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    spread = 12 / np.sqrt(2 * df)
    low, high = max(1e-12, 1 - spread), 1 + spread
    s = (high - low) / 2 * x + (high + low) / 2
    density = np.exp(np.log(2) + df / 2 * np.log(df / 2) - lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    return float((high - low) / 2 * np.sum(w * density * norm_cdf(t * s - shift)))


def fisher_greater(both: int, one: int, other: int, neither: int) -> float:
    """One-sided exact test of a 2 x 2 table: probability of as many in both, or more."""
    a, b, n = both + one, both + other, both + one + other + neither
    k = np.arange(both, min(a, b) + 1)
    choose = lambda m, r: lgamma(m + 1) - _lgamma(np.asarray(r) + 1.0) - _lgamma(m - np.asarray(r) + 1.0)
    logs = choose(a, k) + choose(n - a, b - k) - choose(n, np.array([b]))
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))
