"""Distribution functions for the few rows of a finished report."""

from __future__ import annotations

import math


def _log1p_minus(x: float) -> float:
    """log(1 + x) - x, without loss for small x."""
    if abs(x) > 0.01:
        return math.log1p(x) - x
    term, total, k = x, 0.0, 2
    while True:
        term *= -x
        new = total + term / k
        if new == total:
            return total
        total, k = new, k + 1


def _beyond_stirling(z: float) -> float:
    """log gamma(z) less Stirling's leading terms, for z of 100 and more."""
    return (1 / 12 - (1 / 360 - 1 / (1260 * z * z)) / (z * z)) / z


def _log_beta_term(x: float, a: float, b: float) -> float:
    """log(x^a (1 - x)^b / B(a, b)); large counts don't cancel."""
    if min(a, b) < 100:
        return (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    n = a + b
    d = x * n - a
    return (a * _log1p_minus(d / a) + b * _log1p_minus(-d / b)
            + 0.5 * math.log(a * b / (2 * math.pi * n))
            + _beyond_stirling(n) - _beyond_stirling(a) - _beyond_stirling(b))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(_log_beta_term(x, a, b))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    # The fraction needs a number of terms of the order of the root.
    for m in range(1, 1000 + int(20 * math.sqrt(a + b))):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x
                    / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1.0) < 1e-14:
            return front * f / a
    raise ArithmeticError(f"no convergence at {x}, {a}, {b}")


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if beta_cdf(mid, a, b) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def binomial_interval(r: int, n: int, alpha: float = 0.05,
                      compat: bool = False) -> tuple[float, float]:
    """Exact interval of a proportion. `compat` reuses the F quantile of the
    lower limit for the upper one, as older reports did."""
    if n == 0:
        return float("nan"), float("nan")
    low = 0.0 if r == 0 else beta_quantile(alpha / 2, r, n - r + 1)
    if not compat:
        high = 1.0 if r == n else beta_quantile(1 - alpha / 2, r + 1, n - r)
        return low, high
    if r == 0:
        return float("nan"), float("nan")
    # From the lower limit L = r / (r + (n - r + 1) f) follows f.
    f = r * (1 - low) / (low * (n - r + 1))
    return low, (r + 1) * f / ((n - r) + (r + 1) * f)


def t_two_sided(t: float, dof: float) -> float:
    if math.isnan(t):
        return float("nan")
    return beta_cdf(dof / (dof + t * t), dof / 2.0, 0.5)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_one(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))
