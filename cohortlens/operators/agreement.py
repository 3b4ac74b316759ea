"""How two measurements, two raters, two cohorts or two versions differ: moments, agreement, drift and similarity.

Every statistic is one pre-aggregated table: moments by groups (merged in a numerically stable way by the engine's
variance aggregates), contingency tables of categories, or histograms of scores with running sums by score bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import intervals as ci
from cohortlens.operators.counts import UNKNOWN, unfold
from cohortlens.operators.ranks import cumulated, histogram

#: The share that an empty bin counts as in a stability index.
LEAST_SHARE = 1e-4


def average_precision(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_pos, n_neg, auprc, reason from a score histogram (p, q): precision at each distinct score, ties as one
    step, weighted by the share of positives that have the score."""
    h = cumulated(hist, keys, "s", ["p", "q"])
    tp, fp = F.col("p_all") - F.col("p_before"), F.col("q_all") - F.col("q_before")  # at this score or above
    m = h.groupBy(*keys).agg(F.max("p_all").alias("n_pos"), F.max("q_all").alias("n_neg"), F.sum(F.col("p") * ci.ratio(tp, tp + fp)).alias("won"))
    reason = F.when(F.least("n_pos", "n_neg") == 0, "single_class")
    return m.select(*keys, "n_pos", "n_neg", F.when(reason.isNull(), ci.ratio(F.col("won"), F.col("n_pos"))).alias("auprc"), reason.alias("reason"))


def auprc(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return average_precision(histogram(rows.where(F.col(score).isNotNull()), keys, score), keys)


def ks_drift(rows: DataFrame, cohort: str, reference: str, score: str = "score") -> DataFrame:
    """cohort, n, n_reference and ks_d: the largest distance of its scores' distribution function to the reference cohort's.

    Between two scores of a cohort its own function is level and the other one rises, so the largest distance lies at, or
    just below, a score of the cohort: the reference's running sums over all scores are joined by score.
    """
    h = rows.where(F.col(score).isNotNull() & F.col(cohort).isNotNull()).groupBy(F.col(cohort).alias("cohort"), F.col(score).alias("s")).agg(F.count("*").alias("n"))
    base = h.groupBy("s").agg(F.sum(F.when(F.col("cohort") == reference, F.col("n")).otherwise(0)).alias("m"))
    own = cumulated(h.where(F.col("cohort") != reference), ["cohort"], "s", ["n"])
    both = own.join(cumulated(base, [], "s", ["m"]), "s")
    gap = lambda more: F.abs(ci.ratio(F.col("n_before") + more * F.col("n"), F.col("n_all")) - ci.ratio(F.col("m_before") + more * F.col("m"), F.col("m_all")))
    return both.groupBy("cohort").agg(F.max("n_all").alias("n"), F.max("m_all").alias("n_reference"), F.max(F.greatest(gap(0), gap(1))).alias("ks_d"))


def attribute_drift(rows: DataFrame, cohort: str, reference: str, attributes: list[str]) -> DataFrame:
    """cohort, attribute, psi: the stability index of the attribute's levels (missing ones included) against the reference
    cohort's; a level that one of them lacks counts as a share of LEAST_SHARE there.

    A cohort's levels are joined to the reference's; those it lacks are the reference's whole sum less that of the joined.
    """
    counted = rows.where(F.col(cohort).isNotNull()).groupBy(F.col(cohort).alias("cohort"), *attributes).agg(F.count("*").alias("n"))
    long = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit(UNKNOWN)).alias("bin")) for a in attributes])
    cells = counted.select("cohort", "n", F.explode(long).alias("x")).groupBy("cohort", "x.attribute", "x.bin").agg(F.sum("n").alias("n"))
    share = F.greatest(ci.ratio(F.col("n"), F.sum("n").over(Window.partitionBy("cohort", "attribute"))), F.lit(LEAST_SHARE))
    cells = cells.withColumn("a", share)
    part = lambda a, b: (a - b) * F.log(a / b)
    least = F.lit(LEAST_SHARE)
    base = cells.where(F.col("cohort") == reference).select("attribute", "bin", F.col("a").alias("b"))
    base = base.withColumn("lacking", F.sum(part(least, F.col("b"))).over(Window.partitionBy("attribute")))
    whole = base.groupBy("attribute").agg(F.max("lacking").alias("lacking"))
    both = cells.where(F.col("cohort") != reference).join(base.drop("lacking"), ["attribute", "bin"], "left").withColumn("b0", F.coalesce("b", least))
    sums = both.groupBy("cohort", "attribute").agg(F.sum(part(F.col("a"), F.col("b0"))).alias("met"), F.sum(F.when(F.col("b").isNotNull(), part(least, F.col("b"))).otherwise(0.0)).alias("there"))
    return sums.join(whole, "attribute").select("cohort", "attribute", (F.col("met") + F.col("lacking") - F.col("there")).alias("psi"))


def paired_moments(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """keys, n, bias, loa_low, loa_high, mae, rmse, ccc of two measurements of the same rows; limits need two rows."""
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    d = a - b
    m = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.var_pop(d) + F.avg(d) * F.avg(d)).alias("rmse"),
        F.covar_pop(a, b).alias("cov"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.avg(d).alias("shift"),
    )
    sd = F.when(F.col("n") > 1, F.col("sd"))
    ccc = F.try_divide(2 * F.col("cov"), F.col("va") + F.col("vb") + F.col("shift") * F.col("shift"))
    return m.select(*keys, "n", "bias", (F.col("bias") - 1.96 * sd).alias("loa_low"), (F.col("bias") + 1.96 * sd).alias("loa_high"), "mae", "rmse", ccc.alias("ccc"))


def kappa(rows: DataFrame, keys: list[str], first: Column, second: Column, categories: int) -> DataFrame:
    """keys, n, kappa and quadratic-weighted kappa of two ratings 0 to categories - 1, from one contingency table."""
    t = rows.select(*keys, first.cast("int").alias("i"), second.cast("int").alias("j")).where("i is not null and j is not null").groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    weight = F.pow(F.col("i") - F.col("j"), F.lit(2)) / (categories - 1) ** 2
    seen = t.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("i") != F.col("j"), F.col("n")).otherwise(0)).alias("off"), F.sum(weight * F.col("n")).alias("far"))
    side = lambda c: t.groupBy(*keys, c).agg(F.sum("n").alias(f"n_{c}"))
    each = side("i").join(side("j"), keys).groupBy(*keys).agg(  # categories squared rows a key
        F.sum(F.when(F.col("i") != F.col("j"), F.col("n_i").cast("double") * F.col("n_j")).otherwise(0)).alias("off_chance"), F.sum(weight * F.col("n_i") * F.col("n_j")).alias("far_chance")
    )
    both = seen.join(each, keys)
    agreed = lambda o, e: 1 - F.try_divide(F.col(o).cast("double") * F.col("n"), F.col(e))
    return both.select(*keys, "n", agreed("off", "off_chance").alias("kappa"), agreed("far", "far_chance").alias("kappa_weighted"))


def similarity(rows: DataFrame, side: str, attributes: list[str]) -> DataFrame:
    """attribute, levels, cramers_v and the largest standardised difference of a level's share between the two sides (true, false)."""
    counted = rows.where(F.col(side).isNotNull()).groupBy(*attributes).agg(F.count_if(F.col(side)).alias("n"), F.count_if(~F.col(side)).alias("m"))
    cells = unfold(counted, attributes, ["n", "m"]).where(F.col("attribute").isin(*attributes)).groupBy("attribute", "level").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    w = Window.partitionBy("attribute")
    cells = cells.withColumns({"all_n": F.sum("n").over(w), "all_m": F.sum("m").over(w)})
    a, b = ci.ratio(F.col("n"), F.col("all_n")), ci.ratio(F.col("m"), F.col("all_m"))
    row, total = (F.col("n") + F.col("m")).cast("double"), F.col("all_n") + F.col("all_m")
    part = lambda c: F.try_divide(F.pow(F.col(c) - row * F.col(f"all_{c}") / total, F.lit(2)), row * F.col(f"all_{c}") / total)
    smd = F.try_divide(F.abs(a - b), F.sqrt((a * (1 - a) + b * (1 - b)) / 2))
    out = cells.groupBy("attribute").agg(F.count("*").alias("levels"), F.max("all_n").alias("all_n"), F.max("all_m").alias("all_m"), F.sum(part("n") + part("m")).alias("chi2"), F.max(smd).alias("smd_max"))
    some = (F.col("levels") > 1) & (F.least("all_n", "all_m") > 0)
    return out.select("attribute", "levels", F.when(some, F.sqrt(F.col("chi2") / (F.col("all_n") + F.col("all_m")))).alias("cramers_v"), F.when(some, F.col("smd_max")).alias("smd_max"))
