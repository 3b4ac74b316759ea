"""Two versions of a score on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import intervals as ci
from cohortlens.functions.special import mcnemar_p
from cohortlens.operators import resample
from cohortlens.operators.counts import OperatingPoint


def join_counts(new: DataFrame, prior: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """pairs, label_mismatch, new_only, prior_only (null keys match nothing) and whether all rows pair.

    Of a repeated prior key the first row by ``order`` counts; without it the smallest label.
    """
    a = new.select(F.col(key).alias("k"), F.col("y").alias("ya"), F.lit(1).alias("in_a"))
    b = prior.groupBy(F.col(key).alias("k")).agg((F.min_by("y", order) if order else F.min("y")).alias("yb"), F.lit(1).alias("in_b"))
    both = a.join(b, "k", "full_outer")
    out = both.agg(
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & (F.col("ya") == F.col("yb"))).alias("pairs"),
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & (F.col("ya") != F.col("yb"))).alias("label_mismatch"),
        F.count_if(F.col("in_b").isNull()).alias("new_only"),
        F.count_if(F.col("in_a").isNull()).alias("prior_only"),
    )
    return out.withColumn("paired", (F.col("label_mismatch") == 0) & (F.col("new_only") == 0) & (F.col("prior_only") == 0))


def _rights(points: list[OperatingPoint]) -> Iterator[tuple[str, str, Column, Column, Column]]:
    """op, metric, the rows it is of, and whether the new and the prior version are right there."""
    y = F.col("y") == 1
    for p in points:
        new, old = p.positive(F.col("score")), p.positive(F.col("prior"))
        yield p.id, "sensitivity", y, new, old
        yield p.id, "specificity", ~y, ~new, ~old
        yield p.id, "accuracy", F.lit(True), new == y, old == y


def cell_sums(points: list[OperatingPoint]) -> tuple[dict[str, Column], list[Column]]:
    """Counts of the cells e, f, g, h of all points and metrics as aggregates, and their layout as rows."""
    sums, layout = {}, []
    for op, metric, within, a, b in _rights(points):
        names = [f"{c}_{op}_{metric}" for c in "efgh"]
        sums |= dict(zip(names, (F.count_if(within & a & b), F.count_if(within & a & ~b), F.count_if(within & ~a & b), F.count_if(within & ~a & ~b)), strict=True))
        layout.append(F.struct(F.lit(op).alias("op"), F.lit(metric).alias("metric"), *[F.col(n).alias(c) for n, c in zip(names, "efgh", strict=True)]))
    return sums, layout


def paired_cells(pairs: DataFrame, points: list[OperatingPoint], keys: list[str]) -> DataFrame:
    """keys, op, metric and the cells e, f, g, h (both right, only new, only prior, neither)."""
    sums, layout = cell_sums(points)
    m = pairs.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    return m.select(*keys, F.explode(F.array(*layout)).alias("c")).select(*keys, "c.*")


def paired_differences(cells: DataFrame) -> DataFrame:
    e, f, g, h = (F.col(c) for c in "efgh")
    lo, hi = ci.newcombe_paired(e, f, g, h)
    return cells.withColumns({"n": e + f + g + h, "est": ci.ratio(f - g, e + f + g + h), "ci_lo": lo, "ci_hi": hi})


def clustered_paired_differences(pairs: DataFrame, points: list[OperatingPoint], case: str, keys: list[str], b: int = resample.B) -> DataFrame:
    """keys, op, metric, cases, est, ci_lo, ci_hi, reason: share right now less before, whole cases drawn.

    One aggregate a case holds all points and metrics; cases without a row of a metric are no units of it.
    """
    sums, layout = {}, []
    for op, metric, within, new, old in _rights(points):
        m, u = f"m_{op}_{metric}", f"u_{op}_{metric}"
        sums |= {m: F.count_if(within), u: F.count_if(within & new) - F.count_if(within & old)}
        layout.append(F.struct(F.lit(op).alias("op"), F.lit(metric).alias("metric"), F.col(m).alias("m"), F.col(u).alias("u")))
    units = pairs.groupBy(*keys, case).agg(*[v.alias(k) for k, v in sums.items()]).select(*keys, F.explode(F.array(*layout)).alias("c")).select(*keys, "c.*")
    return resample.bootstrap_units(units.where("m > 0"), [*keys, "op", "metric"], b)


def mcnemar(cells: DataFrame) -> DataFrame:
    """Adds method, statistic and p of the discordant cells f and g; cells are few rows."""

    @F.pandas_udf("method string, statistic double, p double")
    def test(b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mcnemar_p(int(x), int(y)) for x, y in zip(b, c, strict=True)], columns=["method", "statistic", "p"])

    return cells.withColumn("t", test("f", "g")).select("*", "t.*").drop("t")


def unpaired_areas(areas: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Difference of two independent areas (auroc() tables joined on ``on``): variances add."""
    b = other.select(*on, F.col("auc").alias("auc_b"), F.col("se").alias("se_b"), F.col("n_pos").alias("n_pos_b"), F.col("n_neg").alias("n_neg_b"))
    return area_differences(areas.join(b, on))


def area_differences(out: DataFrame) -> DataFrame:
    """unpaired_areas() of rows that hold both areas, the other with the suffix _b."""
    z = ci.z_for()
    enough = (F.least("n_pos", "n_pos_b") >= 10) & (F.least("n_neg", "n_neg_b") >= 10)
    reason = F.when(F.least("n_pos", "n_pos_b") < 10, "insufficient_positives").when(F.least("n_neg", "n_neg_b") < 10, "insufficient_negatives").when((F.col("se") == 0) | (F.col("se_b") == 0), "boundary_estimate")
    se = F.sqrt(F.col("se") * F.col("se") + F.col("se_b") * F.col("se_b"))
    out = out.withColumns({"reason": reason, "est": F.when(enough, F.col("auc") - F.col("auc_b")), "se_diff": se})
    ok = F.col("reason").isNull()
    return out.withColumns({"ci_lo": F.when(ok, F.col("est") - z * F.col("se_diff")), "ci_hi": F.when(ok, F.col("est") + z * F.col("se_diff"))})


def unpaired_differences(new: DataFrame, prior: DataFrame, on: list[str]) -> DataFrame:
    """on, est, ci_lo, ci_hi, flag: proportions (k of n) of two versions on different rows, by squaring and adding."""
    both = new.select(*on, "k", "n").join(prior.select(*on, F.col("k").alias("k2"), F.col("n").alias("n2")), on)
    lo, hi = ci.newcombe(F.col("k"), F.col("n"), F.col("k2"), F.col("n2"))
    est = ci.ratio(F.col("k"), F.col("n")) - ci.ratio(F.col("k2"), F.col("n2"))
    return both.select(*on, "n", "n2", est.alias("est"), lo.alias("ci_lo"), hi.alias("ci_hi"), F.lit("not_like_for_like").alias("flag"), F.when((F.col("n") == 0) | (F.col("n2") == 0), "zero_denominator").alias("reason"))
