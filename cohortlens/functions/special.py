"""Tail probabilities for the few rows of a result table, in plain Python (no SciPy needed)."""

from __future__ import annotations

import math
from collections.abc import Callable


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square law: a finite sum for each parity of ``df``."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return total
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= x / (2 * i + 1)
    return total


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz steps)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, up, down = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        part = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        down = 1 / (1 + part * down or tiny)
        up = 1 + part / up or tiny
        value *= up * down
        if abs(1 - up * down) < 1e-15:
            break
    return front * (value - 1)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    return 0.0 if k < 0 else 1.0 if k >= n else beta_cdf(1 - p, n - k, k + 1)


def _bisect(f: Callable[[float], float]) -> float:
    """Where the increasing f crosses 0 in [0, 1]."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float] | None:
    """Exact bounds: the proportions whose binomial tails at k are (1 - level) / 2."""
    if n <= 0:
        return None
    a = (1 - level) / 2
    low = 0.0 if k == 0 else a ** (1 / n) if k == n else _bisect(lambda p: 1 - binomial_cdf(k - 1, n, p) - a)
    high = 1.0 if k == n else 1 - a ** (1 / n) if k == 0 else _bisect(lambda p: a - binomial_cdf(k, n, p))
    return low, high


def mcnemar_p(b: int, c: int) -> tuple[str, float | None, float]:
    """(method, statistic, p): exact below 25 discordant pairs, else continuity-corrected chi-square."""
    n = b + c
    if n < 25:
        return "exact", None, min(1.0, 2 * binomial_cdf(min(b, c), n, 0.5)) if n else 1.0
    x = max(0, abs(b - c) - 1) ** 2 / n
    return "chi2_continuity", x, math.erfc(math.sqrt(x / 2))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables of its margins that are no more likely."""
    row, col, n = a + b, a + c, a + b + c + d
    log = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    prob = lambda x: math.exp(log(row, x) + log(n - row, col - x) - log(n, col))
    seen = prob(a) * (1 + 1e-7)
    return min(1.0, math.fsum(p for x in range(max(0, col - (n - row)), min(row, col) + 1) if (p := prob(x)) <= seen))


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
