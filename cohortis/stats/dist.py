"""Tail probabilities of a handful of test statistics, on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    # Evaluated from the far end inwards; more terms until the value settles.
    terms, last = 32, None
    while True:
        value = 1.0
        for i in range(terms, 0, -1):
            m = i // 2
            if i % 2:
                d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            value = 1.0 + d / value
        if last is not None and abs(value - last) <= 1e-15 * abs(value) or terms > 1 << 16:
            return front / value
        last, terms = value, terms * 2


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_cdf(t: float, df: float) -> float:
    half = t_p(t, df) / 2
    return 1 - half if t > 0 else half


def t_quantile(p: float, df: float) -> float:
    """The value that a t statistic stays under with probability ``p`` (over one half)."""
    lo, hi = 0.0, 2.0
    while t_cdf(hi, df) < p:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
        if hi - lo <= 1e-14 * hi:
            break
    return (lo + hi) / 2


def f_p(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


_PHI = np.frompyfunc(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), 1, 1)
_Z, _ZW = np.polynomial.legendre.leggauss(160)
_Z, _ZW = _Z * 9.0, _ZW * 9.0
_Z_DENSITY = np.exp(-_Z * _Z / 2) / math.sqrt(2 * math.pi) * _ZW
_Z_CDF = _PHI(_Z).astype(float)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """Range of ``k`` standard normals: the largest sits at z, the others within ``w`` below it."""
    low = _PHI(_Z[None, :] - w[:, None]).astype(float)
    return k * ((_Z_CDF[None, :] - low) ** (k - 1)) @ _Z_DENSITY


def tukey_cdf(q: float, k: int, df: float) -> float:
    """Studentised range of ``k`` means with ``df`` degrees of freedom.

    Beyond 25,000 degrees of freedom the scale counts as known, as usual for this function. Values step there, measured
    against the full integral by at most 1.3e-5 for two means, 3.6e-5 for five, 9.4e-5 for 20 and 2.1e-4 for 100.
    """
    if q <= 0:
        return 0.0
    if df > 25000:
        return float(min(1.0, _range_cdf(np.array([q]), k)[0]))
    # The scale s = sqrt(chi2 / df) lies near 1 with a spread of 1 / sqrt(2 df).
    spread = 1 / math.sqrt(2 * df)
    lo, hi = max(0.0, 1 - 9 * spread), 1 + 12 * spread
    x, w = np.polynomial.legendre.leggauss(80)
    s, w = lo + (x + 1) * (hi - lo) / 2, w * (hi - lo) / 2
    log_f = (
        math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(np.maximum(s, 1e-300)) - df * s * s / 2
    )
    return float(min(1.0, np.sum(np.exp(log_f) * w * _range_cdf(q * s, k))))


def tukey_quantile(p: float, k: int, df: float) -> float:
    lo, hi = 0.0, 8.0
    while tukey_cdf(hi, k, df) < p:
        lo, hi = hi, hi * 2
    # Regula falsi with a bisection safeguard.
    f_lo, f_hi = tukey_cdf(lo, k, df) - p, tukey_cdf(hi, k, df) - p
    for i in range(200):
        mid = (lo + hi) / 2 if i % 3 == 2 else hi - f_hi * (hi - lo) / (f_hi - f_lo)
        f_mid = tukey_cdf(mid, k, df) - p
        if f_mid > 0:
            hi, f_hi = mid, f_mid
        else:
            lo, f_lo = mid, f_mid
        if hi - lo < 1e-10 or abs(f_mid) < 1e-13:
            return mid
    return (lo + hi) / 2
