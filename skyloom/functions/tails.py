"""Tail probabilities for a handful of driver-side test statistics."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    return regularised_beta(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return regularised_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    """P(chi-square >= x)."""
    if x <= 0:
        return 1.0
    a, half = df / 2.0, x / 2.0
    front = math.exp(-half + a * math.log(half) - math.lgamma(a))
    if half < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1.0
            term *= half / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = half + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    out = d
    for i in range(1, 400):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b or tiny)
        c = b + num / c or tiny
        out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def t_quantile_975(df: float) -> float:
    """Two-sided five per cent critical value, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 0.05 else (lo, mid)
    return (lo + hi) / 2


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a Pearson or Spearman coefficient."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
