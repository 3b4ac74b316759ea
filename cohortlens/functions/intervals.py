"""Closed-form intervals over count columns.  Every function returns Columns and stays in generated code."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Bounds = tuple[Column, Column]


def z_for(level: float = 0.95) -> float:
    return NormalDist().inv_cdf(1 - (1 - level) / 2)


def ratio(top: Column, below: Column) -> Column:
    """top / below as a double; null over zero."""
    return F.try_divide(top.cast("double"), below.cast("double"))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def wilson(k: Column, n: Column, z: float = z_for()) -> Bounds:
    """Wilson score bounds of k of n; n may be an effective size; null when n is 0."""
    p = ratio(k, n)
    middle, root, below = 2 * k + z * z, z * F.sqrt(z * z + 4 * k * (1 - p)), 2 * (n + z * z)
    return clip((middle - root) / below), clip((middle + root) / below)


def wilson_continuity(k: Column, n: Column, z: float = z_for()) -> Bounds:
    """Wilson bounds with Newcombe's continuity correction."""
    p = ratio(k, n)
    below = 2 * (n + z * z)
    spread = lambda s: z * F.sqrt(F.greatest(F.lit(0.0), z * z - ratio(F.lit(1), n) + 4 * k * (1 - p) + s * (4 * p - 2)))
    low = F.when(k == 0, 0.0).otherwise((2 * k + z * z - 1 - spread(1)) / below)
    high = F.when(k == n, 1.0).otherwise((2 * k + z * z + 1 + spread(-1)) / below)
    return F.when(n > 0, clip(low)), F.when(n > 0, clip(high))


def wald(k: Column, n: Column, z: float = z_for()) -> Bounds:
    p = ratio(k, n)
    half = z * F.sqrt(ratio(p * (1 - p), n))
    return p - half, p + half


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = z_for(), continuity: bool = False) -> Bounds:
    """Bounds of k1/n1 - k2/n2 by squaring and adding (methods 10 and 11)."""
    own = wilson_continuity if continuity else wilson
    (l1, u1), (l2, u2), p1, p2 = own(k1, n1, z), own(k2, n2, z), ratio(k1, n1), ratio(k2, n2)
    low = p1 - p2 - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    high = p1 - p2 + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return clip(low, -1, 1), clip(high, -1, 1)


def newcombe_paired(e: Column, f: Column, g: Column, h: Column, z: float = z_for()) -> Bounds:
    """Bounds of (f - g) / n for paired cells e, f, g, h (method 10 with the corrected phi)."""
    n = e + f + g + h
    (l1, u1), (l2, u2), p1, p2 = wilson(e + f, n, z), wilson(e + g, n, z), ratio(e + f, n), ratio(e + g, n)
    cross = (e * h - f * g).cast("double")
    product = (e + f).cast("double") * (g + h) * (e + g) * (f + h)
    phi = F.when(product == 0, 0.0).otherwise(F.try_divide(F.when(cross > 0, F.greatest(cross - n / 2, F.lit(0.0))).otherwise(cross), F.sqrt(product)))
    part = lambda a, b: F.sqrt(F.greatest(F.lit(0.0), a * a - 2 * phi * a * b + b * b))
    return clip(p1 - p2 - part(p1 - l1, u2 - p2), -1, 1), clip(p1 - p2 + part(u1 - p1, p2 - l2), -1, 1)


def log_bounds(estimate: Column, se: Column, z: float = z_for()) -> Bounds:
    return estimate * F.exp(-z * se), estimate * F.exp(z * se)


def logit_bounds(p: Column, se: Column, z: float = z_for()) -> Bounds:
    """Bounds on the logit scale of a proportion whose logit has standard error ``se``; null at 0 and 1."""
    inside = (p > 0) & (p < 1)
    eta = F.when(inside, F.log(F.try_divide(p, 1 - p)))
    return expit(eta - z * se), expit(eta + z * se)


def expit(eta: Column) -> Column:
    """Logistic function that overflows for neither sign."""
    return F.when(eta >= 0, 1 / (1 + F.exp(-eta))).otherwise(F.exp(eta) / (1 + F.exp(eta)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    c = F.greatest(F.lit(eps), F.least(p, F.lit(1 - eps)))
    return F.log(c / (1 - c))


def predictive_at_prevalence(tp: Column, pos: Column, tn: Column, neg: Column, prevalence: Column) -> dict[str, tuple[Column, Bounds]]:
    """PPV and NPV at a stated prevalence, with delta-method bounds on the logit scale."""
    se, sp = ratio(tp, pos), ratio(tn, neg)
    ppv = F.try_divide(se * prevalence, se * prevalence + (1 - sp) * (1 - prevalence))
    npv = F.try_divide(sp * (1 - prevalence), sp * (1 - prevalence) + (1 - se) * prevalence)
    ppv_se = F.sqrt(F.try_divide(1 - se, se * pos) + F.try_divide(sp, (1 - sp) * neg))
    npv_se = F.sqrt(F.try_divide(1 - sp, sp * neg) + F.try_divide(se, (1 - se) * pos))
    return {"ppv": (ppv, logit_bounds(ppv, ppv_se)), "npv": (npv, logit_bounds(npv, npv_se))}


def observed_expected(o: Column, e: Column, n: Column, z: float = z_for()) -> tuple[Column, Bounds]:
    """Observed over expected events; bounds on the log scale, null where o is 0 or n."""
    est = ratio(o, e)
    se = F.when((o > 0) & (o < n), F.sqrt(F.try_divide(1 - ratio(o, n), o)))
    return est, log_bounds(est, se, z)


def attainable(n: Column, comparator: str, value: float, z: float = z_for()) -> tuple[Column, Column]:
    """The largest Wilson lower bound that n rows can give, and whether it meets ``value``."""
    most = F.when(n > 0, n / (n + z * z))
    return most, (most >= value if comparator == ">=" else most > value) if comparator in (">", ">=") else F.lit(None).cast("boolean")


def precision_flags(n: Column, events: Column, half_width: Column) -> Column:
    """The first tier that applies: very_low_precision, low_precision, wide_interval; else null."""
    return F.when(n < 10, "very_low_precision").when((n < 30) | (events < 5), "low_precision").when(half_width > 0.10, "wide_interval")


def compare(value: Column, comparator: str, bound: Column | float) -> Column:
    return {">=": value >= bound, ">": value > bound, "<=": value <= bound, "<": value < bound}[comparator]


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)
