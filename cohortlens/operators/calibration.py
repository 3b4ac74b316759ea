"""Calibration of probabilities: totals, binned error, decile curve and logistic recalibration."""

from __future__ import annotations

import math
from collections.abc import Generator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import intervals as ci
from cohortlens.operators.ranks import bucket, cumulated


def summary(rows: DataFrame, keys: list[str], prob: str = "score") -> DataFrame:
    """n, events, O:E with its log-delta bounds, Brier score, its reference and the index of accuracy."""
    p, y = F.col(prob), F.col("y")
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("events"), F.sum(p).alias("expected"), F.avg((p - y) * (p - y)).alias("brier"))
    rate = ci.ratio(F.col("events"), F.col("n"))
    oe, (lo, hi) = ci.observed_expected(F.col("events"), F.col("expected"), F.col("n"))
    reason = F.when((F.col("n") == 0) | (F.col("expected") <= 0), "zero_denominator").when((F.col("events") == 0) | (F.col("events") == F.col("n")), "single_class")
    out = m.withColumns({"brier_ref": rate * (1 - rate), "oe": oe, "oe_lo": lo, "oe_hi": hi, "reason": reason})
    return out.withColumn("ipa", 1 - F.try_divide(F.col("brier"), F.col("brier_ref")))


def equal_width_bin(p: Column, bins: int = 10) -> Column:
    """Index of right-closed bins of [0, 1], the first closed at 0 too; edges are i / bins."""
    passed = F.lit(0)
    for i in range(1, bins):
        passed = passed + (p > i / bins).cast("int")
    return passed


def mass_bins(rows: DataFrame, prob: str, order: str, bins: int = 10) -> DataFrame:
    """rows with ``bin``: equal-mass bins by (prob, order), as ntile over all rows would give.

    The first row of each later bin lies in the rows of one score, at a known place among them.  These borders
    are one row of at most ``bins`` entries; only rows whose score has a border inside are ranked by ``order``,
    by running sums over buckets, so no window spans the table or a frequent score.
    """
    counts = cumulated(rows.groupBy(F.col(prob).alias("s")).agg(F.count("*").alias("c")), [], "s", ["c"])
    first = lambda k: k * F.floor(F.col("c_all") / bins) + F.least(k, F.col("c_all") % bins)
    inside = F.filter(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: (first(k) >= F.col("c_before")) & (first(k) < F.col("c_before") + F.col("c")))
    borders = counts.select("s", "c_before", "c_all", F.explode(inside).alias("k")).select(F.struct("s", (first(F.col("k")) - F.col("c_before")).alias("skip")).alias("border"))
    borders = F.broadcast(borders.agg(F.collect_list("border").alias("_borders")))  # one row
    d = rows.crossJoin(borders)
    score = F.col(prob)
    passed = lambda rank: F.size(F.filter("_borders", lambda x: (score > x["s"]) | ((score == x["s"]) & (rank >= x["skip"])))).cast("long")
    split = F.exists("_borders", lambda x: (score == x["s"]) & (x["skip"] > 0))
    plain = d.where(~F.coalesce(split, F.lit(False))).withColumn("bin", passed(F.lit(0)))
    ranked = cumulated(d.where(split).withColumn("_one", F.lit(1)), [prob], order, ["_one"])
    ranked = ranked.withColumn("bin", passed(F.col("_one_before"))).drop("_one", "_one_before", "_one_all")
    return plain.unionByName(ranked).drop("_borders")


def binned(rows: DataFrame, prob: str) -> DataFrame:
    """bin, n, events, mean_pred, score_min, score_max and the observed rate of rows with ``bin``."""
    m = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("events"), F.avg(prob).alias("mean_pred"), F.min(prob).alias("score_min"), F.max(prob).alias("score_max"))
    lo, hi = ci.wilson(F.col("events"), F.col("n"))
    return m.withColumns({"observed": ci.ratio(F.col("events"), F.col("n")), "ci_lo": lo, "ci_hi": hi})


def curve(bins: DataFrame, count: int = 10) -> DataFrame:
    """A binned() table with a row for each of ``count`` bins; empty ones have the reason zero_denominator."""
    every = bins.sparkSession.range(count).select(F.col("id").alias("bin"))
    out = F.broadcast(every).join(bins, "bin", "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "events": F.coalesce("events", F.lit(0)), "reason": F.when(F.col("n").isNull(), "zero_denominator")})


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error of a binned() table; no interval by design."""
    return bins.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("observed") - F.col("mean_pred"))) / F.sum("n")).alias("ece"))


#: Newton steps, halvings of a step, tolerances of a step and of a separated fit (fixed values).
STEPS, HALVINGS, SETTLED, SEPARATED = 100, 30, 1e-10, 1e-8
Point = tuple[float, float]


def _newton(slope: bool, start: Point | None = None) -> Generator[Point, list[float], dict]:
    """One fit as a dialogue: yields (intercept, slope) and is sent the sums of ``_sums`` there."""
    a, b = start or (0.0, 0.0 if slope else 1.0)
    s = yield a, b
    for _ in range(STEPS):
        det = s[0] * s[2] - s[1] * s[1] if slope else s[0]
        if not det > 0:
            break
        da, db = ((s[2] * s[3] - s[1] * s[4]) / det, (s[0] * s[4] - s[1] * s[3]) / det) if slope else (s[3] / s[0], 0.0)
        share = 1.0
        for _ in range(HALVINGS):
            new = yield a + share * da, b + share * db
            if new[5] <= s[5] + 1e-12 * abs(s[5]):
                break
            share /= 2
        else:
            break
        a, b, s = a + share * da, b + share * db, new
        if s[6] < SEPARATED:
            return {"reason": "complete_separation"}
        if max(abs(share * da) / (1 + abs(a)), abs(share * db) / (1 + abs(b))) <= SETTLED:
            det = s[0] * s[2] - s[1] * s[1] if slope else s[0]
            return {"est": (a, b), "se": (math.sqrt(s[2] / det), math.sqrt(s[0] / det)) if slope else (1 / math.sqrt(s[0]),), "reason": None}
    return {"reason": "irls_not_converged"}


def _sums(at: Point, k: int) -> list[Column]:
    """Information, score, deviance and largest residual of the cells (x, y, c) at a point."""
    x, y, c = F.col("x"), F.col("y"), F.col("c")
    eta = at[0] + at[1] * x
    mu = ci.expit(eta)
    w, r = c * mu * (1 - mu), c * (y - mu)
    deviance = -2 * c * (y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))
    parts = [F.sum(w), F.sum(w * x), F.sum(w * x * x), F.sum(r), F.sum(r * x), F.sum(deviance), F.max(F.abs(y - mu))]
    return [p.alias(f"f{k}_{i}") for i, p in enumerate(parts)]


def _near(x: np.ndarray, y: np.ndarray, c: np.ndarray, slope: bool) -> Point | None:
    """Where a fit of cells in memory ends, if it converges."""
    fit = _newton(slope)
    a, b = next(fit)
    try:
        while True:
            eta = a + b * x
            mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            w, r = c * mu * (1 - mu), c * (y - mu)
            deviance = float((-2 * c * (y * eta - np.logaddexp(0, eta))).sum())
            a, b = fit.send([float(v) for v in (w.sum(), (w * x).sum(), (w * x * x).sum(), r.sum(), (r * x).sum(), deviance, np.abs(y - mu).max())])
    except StopIteration as end:
        if end.value["reason"]:
            return None
        est = end.value["est"]
        return (est[0], est[1] if slope else 1.0)


def irls(rows: DataFrame, prob: str = "score", slopes: tuple[bool, ...] = (True,)) -> list[dict]:
    """Logistic recalibration of y on logit(prob), a fit each of ``slopes``: intercept and slope, or the intercept
    with logit(prob) as offset.

    Rows are compressed to distinct (prob, y); all fits advance together, by one aggregate of that table a step.  They
    start where a fit of the score buckets' means ends (a bounded table, fitted on the driver), so few steps are left.
    A fit is est, se (tuples) or a typed reason.
    """
    cells = rows.groupBy(F.col(prob).alias("p"), "y").agg(F.count("*").alias("c")).select(ci.logit(F.col("p")).alias("x"), F.col("y").cast("double").alias("y"), "c").cache()
    try:
        means = cells.groupBy(bucket(ci.expit(F.col("x"))).alias("of"), "y").agg((F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("x"), F.sum("c").cast("double").alias("c"))
        means = [x.to_numpy() for x in means.select("x", "y", "c").toArrow().columns]
        two = len(means[0]) > 1 and means[0].min() < means[0].max() and means[1].min() < means[1].max()
        open_ = {k: _newton(slope, _near(*means, slope) if two else None) for k, slope in enumerate(slopes)}
        points, done = {k: next(f) for k, f in open_.items()}, {}
        whole = [F.sum("c").alias("n"), F.sum(F.col("c") * F.col("y")).alias("events"), F.min("x").alias("low"), F.max("x").alias("high")]
        while points:
            found = cells.agg(*whole, *[p for k, at in points.items() for p in _sums(at, k)]).first()
            if not found["n"]:
                return [{"reason": "zero_denominator"}] * len(slopes)
            if found["events"] in (0, found["n"]):
                return [{"reason": "single_class"}] * len(slopes)
            for k in list(points):
                if slopes[k] and found["low"] == found["high"]:
                    done[k] = {"reason": "constant_score"}
                    del points[k]
                    continue
                try:
                    points[k] = open_[k].send([found[f"f{k}_{i}"] for i in range(7)])
                except StopIteration as end:
                    done[k] = end.value
                    del points[k]
        return [done[k] for k in range(len(slopes))]
    finally:
        cells.unpersist()


def recalibration(rows: DataFrame, prob: str = "score") -> DataFrame:
    """parameter, est, se, ci_lo, ci_hi, reason for intercept_large, intercept and slope."""
    z, out = ci.z_for(), []
    large, both = irls(rows, prob, (False, True))
    for name, fit, k in (("intercept_large", large, 0), ("intercept", both, 0), ("slope", both, 1)):
        if fit["reason"]:
            out.append((name, None, None, None, None, fit["reason"]))
        else:
            est, se = fit["est"][k], fit["se"][k]
            out.append((name, est, se, est - z * se, est + z * se, None))
    return rows.sparkSession.createDataFrame(out, "parameter string, est double, se double, ci_lo double, ci_hi double, reason string")
