"""Rank statistics from score histograms, by sums over score buckets and a window inside each bucket.

Distinct scores may be as many as rows, so no window spans a whole key.  ``bucket`` maps a number to an integer
that never falls as the number rises, with ``OCTAVE`` buckets for every halving of the distance to 0 or to 1;
there are at most some hundred thousand of them whatever the data.  Running sums are those of the buckets before
(one small table) plus those inside the bucket (one window a bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import intervals as ci

OCTAVE, FAR = 256, 1_000_000


def bucket(x: Column) -> Column:
    """A whole number that never falls as x rises; null for null."""
    steps = lambda v: F.floor(OCTAVE * F.log2(v))
    return (
        F.when(x >= 1, FAR + steps(x))
        .when(x > 0.5, -OCTAVE - F.floor(OCTAVE * (F.log2(1 - x) + 1)))
        .when(x > 0, steps(x))
        .when(x < 0, -FAR - steps(-x))
        .when(x == 0, -FAR // 2)
    ).cast("long")


def text_bucket(x: Column) -> Column:
    """A whole number that never falls as a text rises in the order of its bytes: its first three."""
    return F.conv(F.rpad(F.substring(F.hex(x.cast("binary")), 1, 6), 6, "0"), 16, 10).cast("long")


def cumulated(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """rows (distinct in keys and ``order``) with the sums of each value over smaller ``order`` (v_before) and over the key (v_all)."""
    of = text_bucket(F.col(order)) if dict(rows.dtypes)[order] == "string" else bucket(F.col(order).cast("double"))
    # one struct as key: it equals itself with nulls inside, so that aggregate, join and window share one shuffle
    rows = rows.withColumn("_bucket", F.struct(*keys, of.alias("_number")))
    per = rows.groupBy("_bucket").agg(*[F.sum(v).alias(v) for v in values])
    key = Window.partitionBy(*[F.col("_bucket")[k] for k in keys])
    before = key.orderBy(F.col("_bucket")["_number"]).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_bucket", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}_off") for v in values], *[F.sum(v).over(key).alias(f"{v}_all") for v in values])
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(per, "_bucket").withColumns({f"{v}_before": F.col(f"_{v}_off") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return out.drop("_bucket", *[f"_{v}_off" for v in values])


def histogram(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, s, p and q: positives and negatives at each distinct score."""
    return rows.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))


def placements(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Adds totals, v10 (share of negatives below, half for ties) and v01 (share of positives above)."""
    out = cumulated(hist, keys, "s", ["p", "q"]).withColumnsRenamed({"p_all": "np", "q_all": "nq", "q_before": "q_less", "p_before": "p_less"})
    return out.withColumns({"v10": ci.ratio(F.col("q_less") + F.col("q") / 2, F.col("nq")), "v01": 1 - ci.ratio(F.col("p_less") + F.col("p") / 2, F.col("np"))})


def auroc(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, n_pos, n_neg, auc, se (DeLong): one histogram, running sums by bucket."""
    return areas(histogram(rows, keys, score), keys)


def areas(hist: DataFrame, keys: list[str]) -> DataFrame:
    """auroc() of a histogram that is already there."""
    v = placements(hist, keys)
    m = v.groupBy(*keys).agg(F.max("np").alias("n_pos"), F.max("nq").alias("n_neg"), F.sum(F.col("p") * F.col("v10")).alias("a1"), F.sum(F.col("p") * F.col("v10") * F.col("v10")).alias("a2"), F.sum(F.col("q") * F.col("v01")).alias("b1"), F.sum(F.col("q") * F.col("v01") * F.col("v01")).alias("b2"))
    auc = ci.ratio(F.col("a1"), F.col("n_pos"))
    spread = lambda two, one, n: F.try_divide(F.greatest(F.lit(0.0), F.col(two) - F.try_divide(F.col(one) * F.col(one), F.col(n))), F.col(n) - 1)
    variance = F.try_divide(spread("a2", "a1", "n_pos"), F.col("n_pos")) + F.try_divide(spread("b2", "b1", "n_neg"), F.col("n_neg"))
    return m.select(*keys, "n_pos", "n_neg", auc.alias("auc"), F.sqrt(variance).alias("se"))


def auroc_interval(areas: DataFrame) -> DataFrame:
    """Adds the interval of auroc(): logit beyond 0.9 or for small classes, else Wald; reasons as typed text."""
    z, a, se = ci.z_for(), F.col("auc"), F.col("se")
    small = F.least("n_pos", "n_neg")
    reason = F.when(small == 0, "single_class").when(F.col("n_pos") < 2, "insufficient_positives").when(F.col("n_neg") < 2, "insufficient_negatives").when((a <= 0) | (a >= 1) | (se == 0), "boundary_estimate")
    method = F.when((a > 0.9) | (small < 30), "delong_logit").otherwise("delong_wald")
    llo, lhi = ci.logit_bounds(a, F.try_divide(se, a * (1 - a)))
    out = areas.withColumns({"reason": reason, "method": F.when(reason.isNull(), method)})
    lo, hi = F.when(F.col("method") == "delong_logit", llo).otherwise(ci.clip(a - z * se)), F.when(F.col("method") == "delong_logit", lhi).otherwise(ci.clip(a + z * se))
    return out.withColumns({"ci_lo": F.when(F.col("reason").isNull(), lo), "ci_hi": F.when(F.col("reason").isNull(), hi), "flag": F.when(small < 10, "very_low_precision")})


def midranks(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values with their count and average rank."""
    h = rows.groupBy(F.col(value).alias("s")).agg(F.count("*").alias("n"))
    return cumulated(h, [], "s", ["n"]).select("s", "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("midrank"))


def roc_curve(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, threshold, tp, fp, tpr, fpr: one vertex a distinct score, and the start (0, 0) without a threshold."""
    h = cumulated(histogram(rows, keys, score), keys, "s", ["p", "q"])
    at = h.select(*keys, F.col("s").alias("threshold"), (F.col("p_all") - F.col("p_before")).alias("tp"), (F.col("q_all") - F.col("q_before")).alias("fp"), F.col("p_all").alias("np"), F.col("q_all").alias("nq"))
    start = h.groupBy(*keys).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.max("p_all").alias("np"), F.max("q_all").alias("nq"))
    return at.unionByName(start).select(*keys, "threshold", "tp", "fp", ci.ratio(F.col("tp"), F.col("np")).alias("tpr"), ci.ratio(F.col("fp"), F.col("nq")).alias("fpr"))


def paired_delong(rows: DataFrame, keys: list[str], first: str = "score", second: str = "prior") -> DataFrame:
    """Difference of two scores' areas on the same rows: placements by histogram, covariance by class."""
    sides = []
    for name, score in (("1", first), ("2", second)):
        v = placements(histogram(rows, keys, score), keys).select(*keys, F.col("s").alias(f"s{name}"), F.col("v10").alias(f"v10_{name}"), F.col("v01").alias(f"v01_{name}"))
        sides.append(v)
    cells = rows.groupBy(*keys, F.col(first).alias("s1"), F.col(second).alias("s2")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    both = cells.join(sides[0], [*keys, "s1"]).join(sides[1], [*keys, "s2"])
    sums = {"np": F.sum("p"), "nq": F.sum("q")}
    for w, v in (("p", "v10"), ("q", "v01")):
        a, b, n = F.col(f"{v}_1"), F.col(f"{v}_2"), F.col(w)
        sums |= {f"{w}1": F.sum(n * a), f"{w}2": F.sum(n * b), f"{w}11": F.sum(n * a * a), f"{w}22": F.sum(n * b * b), f"{w}12": F.sum(n * a * b)}
    m = both.groupBy(*keys).agg(*[x.alias(k) for k, x in sums.items()])

    def cov(w: str, i: int, j: int):  # noqa: ANN202
        n = F.col("np" if w == "p" else "nq")
        return F.try_divide(F.try_divide(F.col(f"{w}{i}{j}") - F.try_divide(F.col(f"{w}{i}") * F.col(f"{w}{j}"), n), n - 1), n)

    s = lambda i, j: cov("p", i, j) + cov("q", i, j)
    variance = F.greatest(F.lit(0.0), s(1, 1) + s(2, 2) - 2 * s(1, 2))
    a1, a2, z = ci.ratio(F.col("p1"), F.col("np")), ci.ratio(F.col("p2"), F.col("np")), ci.z_for()
    out = m.select(*keys, F.col("np").alias("n_pos"), F.col("nq").alias("n_neg"), a1.alias("auc_new"), a2.alias("auc_prior"), (a1 - a2).alias("est"), F.sqrt(variance).alias("se"))
    return out.withColumns({"ci_lo": F.col("est") - z * F.col("se"), "ci_hi": F.col("est") + z * F.col("se"), "z": F.try_divide(F.col("est"), F.col("se"))})


def holm(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Adds p_holm: step-down within each family."""
    w = Window.partitionBy(*family).orderBy(p)
    size = F.count("*").over(Window.partitionBy(*family))
    return tests.withColumn("_scaled", F.least(F.lit(1.0), F.col(p) * (size - F.row_number().over(w) + 1))).withColumn("p_holm", F.max("_scaled").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_scaled")
