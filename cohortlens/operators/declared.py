"""What declarations change in an analysis: orientation, bands, reference levels, thresholds, checks and criteria."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import intervals as ci
from cohortlens.operators import compare, counts, ranks, resample
from cohortlens.operators.counts import OVERALL, UNKNOWN, OperatingPoint
from cohortlens.sources.declare import Declarations
from cohortlens.sources.ingest import InputError, to_double

#: Metrics of a 2 x 2 table without an interval for clustered rows, and those whose criteria can be out of reach (fixed values).
NO_CLUSTERED_INTERVAL = ("youden", "balanced_accuracy", "lr_pos", "lr_neg", "dor", "f1", "mcc")
PROPORTIONS = ("sensitivity", "specificity", "ppv", "npv", "accuracy")
GAPS = ("tpr_gap", "fpr_gap", "ppv_gap", "npv_gap", "selection_rate_gap", "auroc_gap")
DATASETS = ("dev", "test")


@dataclass(frozen=True)
class PredictedPoint:
    """The one operating point of a table that has predictions (y_pred) but no score."""

    id: str
    positive_class: str

    def positive(self, score: Column) -> Column:  # noqa: ARG002
        return F.col("y_pred") == self.positive_class


def points_of(d: Declarations, scored: bool) -> list:
    """The declared points, or the predicted one; H08 where y_pred would stand for several."""
    if scored:
        return list(d.points)
    if len(d.points) > 1 and d.predicted_point is None:
        raise InputError(f"H08: {len(d.points)} operating points for a table without a score")
    return [PredictedPoint(d.predicted_point or d.points[0].id, d.positive)]


def oriented(rows: DataFrame, d: Declarations) -> DataFrame:
    """Adds rank_score, which rises with the positive class, and probability (null unless the score is one of it)."""
    score = F.col("score").cast("double")
    return rows.withColumns({"rank_score": score if d.higher_is_positive else -score, "probability": score if d.probability and d.higher_is_positive else F.lit(None).cast("double")})


def banded(rows: DataFrame, d: Declarations) -> DataFrame:
    """Numeric attributes with declared bands become their bands' names."""
    return rows.withColumns({a: counts.band(F.col(a), b) for a, b in d.bands.items()}) if d.bands else rows


def band_losses(rows: DataFrame, column: str, bands: list[tuple[float, float]]) -> DataFrame:
    """n_missing, n_outside: rows that no band takes."""
    x = F.col(column)
    return rows.agg(F.count_if(x.isNull()).alias("n_missing"), F.count_if(x.isNotNull() & (counts.band(x, bands) == UNKNOWN)).alias("n_outside"))


def reference_levels(sizes: DataFrame, d: Declarations) -> DataFrame:
    """attribute, reference: the declared level, which must have rows, or else the largest known one."""
    named = {a: r for a, r in d.references.items() if r is not None}
    if not named:
        return counts.reference_levels(sizes)
    said = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    seen = {(r["attribute"], r["level"]) for r in sizes.where((F.col("level") == said[F.col("attribute")]) & (F.col("n") > 0)).select("attribute", "level").collect()}  # one row a declaration
    absent = sorted(a for a, r in named.items() if (a, r) not in seen or r == UNKNOWN)
    if absent:
        raise InputError(f"H09: no analysed row has the reference level of {', '.join(absent)}")
    return counts.reference_levels(sizes).select("attribute", F.coalesce(said[F.col("attribute")], "reference").alias("reference"))


def level_order(levels: DataFrame) -> DataFrame:
    """Adds position: an attribute's levels by name from 1, missing values last."""
    w = Window.partitionBy("attribute").orderBy((F.col("level") == UNKNOWN).cast("int"), "level")
    return levels.withColumn("position", F.row_number().over(w))


def first_appearance(rows: DataFrame, case: str, order: str) -> DataFrame:
    """case and its place (from 0) by its first row; order is a number that differs between rows."""
    firsts = rows.where(F.col(case).isNotNull()).groupBy(case).agg(F.min(order).alias("first"), F.lit(1).alias("one"))
    return ranks.cumulated(firsts, [], "first", ["one"]).select(case, F.col("one_before").cast("long").alias("place"))


def input_checks(raw: DataFrame, period: str | None = None) -> DataFrame:
    """step, code, role, n, halts of a table of text cells whose columns are named by role.

    S01: a required column is missing.  S02: cells with control characters, scores that are no finite number,
    values of dataset other than dev and test.  S05: blank case ids.  S03: the declared period column is missing.
    """
    there = set(raw.columns)
    held = lambda c, test: F.count_if(test) if c in there else F.lit(0).cast("long")
    number = to_double(F.col("score")) if "score" in there else F.lit(None)
    unfit = F.col("score").isNotNull() & (number.isNull() | (F.abs(number) == float("inf"))) if "score" in there else F.lit(False)
    one = raw.agg(
        sum((F.count_if(F.col(f"`{c}`").rlike(r"[\x00-\x1f\x7f-\x9f]")) for c in raw.columns), F.lit(0)).alias("control"),
        held("score", unfit).alias("score"),
        held("case_id", F.col("case_id").isNull()).alias("case_id") if "case_id" in there else F.lit(0).cast("long").alias("case_id"),
        F.count_distinct(F.when(~F.col("dataset").isin(*DATASETS), F.col("dataset"))).alias("dataset") if "dataset" in there else F.lit(0).cast("long").alias("dataset"),
    )
    fixed = lambda bad: F.lit(int(bad)).cast("long")
    found = (
        ("S01", "y_true", fixed("y_true" not in there)), ("S01", "score", fixed(not there & {"score", "y_pred"})), ("S02", "any", F.col("control").cast("long")), ("S02", "score", F.col("score")),
        ("S05", "case_id", F.col("case_id")), ("S03", "period", fixed(period is not None and period not in there)), ("S02", "dataset", F.col("dataset")),
    )
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(c).alias("code"), F.lit(r).alias("role"), n.alias("n")) for i, (c, r, n) in enumerate(found)])
    return one.select(F.explode(rows).alias("x")).select("x.*", (F.col("x.n") > 0).alias("halts"))


def flow_block(rows: DataFrame, case: str, site: str) -> DataFrame:
    """The waterfall with n_sites, whether rows are clustered in cases, and how that is known."""
    kept = F.col("flow_state") == "analysed"
    more = rows.agg(F.count_distinct(F.when(kept, F.col(site))).alias("n_sites"))
    out = counts.waterfall(rows, case).crossJoin(more)  # one row each
    return out.withColumns({"clustered": F.col("n_cases") < F.col("analysed"), "route": F.when(F.col("n_cases") < F.col("analysed"), "detected").otherwise("none")})


def table_one(rows: DataFrame, attributes: list[str], dev: Column, analysed: Column) -> DataFrame:
    """attribute, level, position, n and pct of the analysed rows, n_dev and pct_dev of the development rows."""
    h = rows.groupBy(*attributes).agg(F.count_if(analysed).alias("n"), F.count_if(dev).alias("n_dev"))
    long = counts.unfold(h, attributes, ["n", "n_dev"]).where(F.col("attribute") != OVERALL[0])
    out = long.groupBy("attribute", "level").agg(F.sum("n").alias("n"), F.sum("n_dev").alias("n_dev")).where("n + n_dev > 0")
    w = Window.partitionBy("attribute")
    share = lambda c: F.try_divide(100.0 * F.col(c), F.sum(c).over(w))
    return level_order(out.withColumns({"pct": share("n"), "pct_dev": share("n_dev")}))


def hits_by_level(rows: DataFrame, case: str, attributes: list[str], point: OperatingPoint) -> DataFrame:
    """attribute, level, metric, case, m rows and u right ones of the five proportions at a point, one row a case."""
    y, p = F.col("y") == 1, point.positive(F.col("score"))
    within = {"sensitivity": (y, p), "specificity": (~y, ~p), "ppv": (p, y), "npv": (~p, ~y), "accuracy": (F.lit(True), y == p)}
    sums = {f"{x}_{m}": F.count_if(t if x == "m" else t & h) for m, (t, h) in within.items() for x in "mu"}
    per = rows.groupBy(*attributes, case).agg(*[v.alias(k) for k, v in sums.items()])
    long = counts.unfold(per, attributes, [case, *sums]).groupBy("attribute", "level", case).agg(*[F.sum(k).alias(k) for k in sums])
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m_{m}").alias("m"), F.col(f"u_{m}").alias("u")) for m in within])
    return long.select("attribute", "level", case, F.explode(parts).alias("x")).select("attribute", "level", case, "x.*").where("m > 0")


def paired_by_level(pairs: DataFrame, points: list[OperatingPoint], attributes: list[str]) -> DataFrame:
    """attribute, level, op, metric, e, f, g, h: paired cells of overall and every level, from one pass over the pairs."""
    sums, layout = compare.cell_sums(points)
    per = pairs.groupBy(*attributes).agg(*[v.alias(k) for k, v in sums.items()])
    long = counts.unfold(per, attributes, list(sums)).groupBy("attribute", "level").agg(*[F.sum(k).alias(k) for k in sums])
    return long.select("attribute", "level", F.explode(F.array(*layout)).alias("c")).select("attribute", "level", "c.*")


def complement_areas(hist: DataFrame) -> DataFrame:
    """attribute, level, n_pos, n_neg, auc, se of the rows outside each level, of histograms (attribute, level, s, p, q)."""
    hist = hist.where(F.col("attribute") != OVERALL[0])
    levels = hist.select("attribute", "level").distinct()
    whole = hist.groupBy("attribute", "s").agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q")).join(levels, "attribute")
    rest = whole.join(hist, ["attribute", "level", "s"], "left")
    rest = rest.select("attribute", "level", "s", (F.col("all_p") - F.coalesce("p", F.lit(0))).alias("p"), (F.col("all_q") - F.coalesce("q", F.lit(0))).alias("q"))
    return ranks.areas(rest.where("p + q > 0"), ["attribute", "level"])


def calibration_block(summary: DataFrame, d: Declarations) -> DataFrame:
    """A calibration.summary() with few (under 200 events or non-events); all null, with a reason, unless the score
    is a probability of the positive class."""
    fits = F.lit(d.probability and d.higher_is_positive)
    few = (F.col("events") < 200) | (F.col("n") - F.col("events") < 200)
    numbers = ["expected", "brier", "brier_ref", "oe", "oe_lo", "oe_hi", "ipa"]
    return summary.withColumns({**{c: F.when(fits, F.col(c)) for c in numbers}, "few": few, "reason": F.when(~fits, "calibration_suppressed").otherwise(F.col("reason"))})


#: Columns of the cells that criteria are held against; quantity is value, or paired_difference_vs_prior.
CELL = ("quantity", "attribute", "level", "op", "metric", "n", "est", "ci_lo", "ci_hi", "suppressed")


def cells_of(df: DataFrame, **given: Column) -> DataFrame:
    """CELL columns of a result table; what it lacks is null, quantity value, suppressed false."""
    base = {"quantity": F.lit("value"), "op": F.lit(None).cast("string"), "suppressed": F.lit(False), "n": F.lit(None).cast("long"), "ci_lo": F.lit(None).cast("double"), "ci_hi": F.lit(None).cast("double")}
    return df.select(*[(given.get(c, F.col(c) if c in df.columns else base.get(c))).alias(c) for c in CELL])


def evaluate(criteria: DataFrame, cells: DataFrame, references: DataFrame) -> DataFrame:
    """id, attribute, level, op, metric, stat, status, reason, most_attainable, attainable: a row a criterion and level.

    criteria: id, quantity, attribute, level (``*``: every known level), op or null, metric, statistic, comparator,
    value.  references: attribute, reference of the gaps.  Reasons come in this order: no cell (by kind),
    suppressed, no interval; a compared statistic has statistic_compared.
    """
    levels = cells.select("attribute", "level").distinct()
    known = levels.where(F.col("level") != UNKNOWN).withColumnRenamed("level", "each")
    star = criteria.where("level = '*'").join(known, "attribute", "left").withColumn("level", F.coalesce("each", "level")).drop("each")
    rows = criteria.where("level <> '*'").unionByName(star)
    there = cells.withColumns({"known": F.lit(True), "suppressed": F.coalesce("suppressed", F.lit(True))}).withColumnsRenamed({c: f"c_{c}" for c in ("quantity", "attribute", "level", "op", "metric")})
    match = F.lit(True)
    for c in ("quantity", "attribute", "level", "op", "metric"):
        match = match & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    out = rows.join(there, match, "left").join(levels.withColumn("tabulated", F.lit(True)), ["attribute", "level"], "left").join(references, "attribute", "left")
    kinds = cells.groupBy().agg(F.count_if(F.col("quantity") != "value").alias("compared"), F.collect_set(F.when((F.col("attribute") == OVERALL[0]) & (F.col("quantity") == "value"), F.col("metric"))).alias("overall"))
    out = out.crossJoin(F.broadcast(kinds))  # one row
    stat = F.when(F.col("statistic") == "estimate", F.col("est")).when(F.col("statistic") == "ci_lower_bound", F.col("ci_lo")).otherwise(F.col("ci_hi"))
    paired = F.col("quantity") != "value"
    reason = (
        F.when(F.col("known").isNull() & paired & (F.col("compared") == 0), "requires_compare")
        .when(F.col("known").isNull() & paired & F.col("metric").isin("ppv", "npv"), "metric_not_compared")
        .when(F.col("tabulated").isNull(), "level_absent")
        .when(F.col("known").isNull() & paired, "comparison_not_computed_for_scope")
        .when(F.col("known").isNull() & F.col("metric").isin(*GAPS) & (F.col("level") == F.col("reference")), "level_is_reference")
        .when(F.col("known").isNull() & F.col("metric").isin(*GAPS), "gap_requires_fairness_attribute")
        .when(F.col("known").isNull() & F.array_contains("overall", F.col("metric")) & (F.col("attribute") != OVERALL[0]), "metric_not_computed_for_scope")
        .when(F.col("known").isNull(), "metric_not_computed")
        .when(F.col("suppressed"), "suppressed")
        .when(F.col("ci_lo").isNull() | stat.isNull(), "no_interval")
        .otherwise("statistic_compared")
    )
    out = out.withColumns({"stat": stat, "reason": reason})
    holds = F.lit(False)
    for c in (">=", ">", "<=", "<"):
        holds = F.when(F.col("comparator") == c, ci.compare(F.col("stat"), c, F.col("value"))).otherwise(holds)
    counted = F.col("reason") == "statistic_compared"
    bound = F.col("metric").isin(*PROPORTIONS) & (F.col("statistic") == "ci_lower_bound") & F.col("comparator").isin(">=", ">") & ~paired
    most = F.when(bound & (F.col("n") > 0), F.col("n") / (F.col("n") + ci.z_for() ** 2))
    reach = F.when(F.col("comparator") == ">=", most >= F.col("value")).otherwise(most > F.col("value"))
    return out.select("id", "attribute", "level", "op", "metric", F.when(counted, F.col("stat")).alias("stat"), F.when(counted, F.when(holds, "met").otherwise("not_met")).otherwise("not_assessable").alias("status"), "reason", most.alias("most_attainable"), reach.alias("attainable"))


def pruned(rows: DataFrame, roles: set[str]) -> DataFrame:
    """The columns that an analysis reads: those named by role, attributes and raters; a scan then reads no others."""
    return rows.select(*[f"`{c}`" for c in rows.columns if c in roles or c.startswith(("attr_", "rater_"))])


def ingest_report(rows: DataFrame, d: Declarations, roles: dict[str, str], flow: DataFrame) -> DataFrame:
    """One row of aggregates on what was read: the headers' hash, the roles, unused columns, the flow, the declarations.

    roles: header -> role or ``ignored``; flow: a flow_block() of the same rows.
    """
    headers = "\n".join(sorted(c.strip() for c in roles))
    used = sorted({r for r in roles.values() if r != "ignored"})
    given = {
        "headers_sha256": F.sha2(F.lit(headers), 256), "roles_present": F.lit(",".join(used)), "n_unused_columns": F.lit(sum(r == "ignored" for r in roles.values())).cast("long"),
        "n_rater_columns": F.lit(sum(r.startswith("rater_") for r in used)).cast("long"), "attributes": F.lit(",".join(sorted(d.attributes))), "positive": F.lit(d.positive),
        "orientation": F.lit("higher_is_positive" if d.higher_is_positive else "lower_is_positive"), "points": F.lit(",".join(p.id for p in d.points)),
    }
    return flow.withColumns(given)


def area_routes(areas: DataFrame, clustered: bool) -> DataFrame:
    """Adds route (which interval an area gets) and analytic (what became of the DeLong one).

    Cases in clusters: cluster_bootstrap; under ten rows of a class: row_bootstrap beside DeLong; else DeLong.
    """
    small = F.least("n_pos", "n_neg") < 10
    route = F.when(F.lit(clustered), "cluster_bootstrap").when(small, "row_bootstrap").otherwise("delong")
    usable = (F.least("n_pos", "n_neg") >= 2) & (F.col("auc") > 0) & (F.col("auc") < 1) & (F.col("se") > 0)
    analytic = F.when(F.lit(clustered), "refused_clustered").when(small, "replaced_small_class").when(usable, "used").otherwise("unavailable")
    return areas.withColumns({"route": route, "analytic": analytic})


def routed_areas(rows: DataFrame, areas: DataFrame, attributes: list[str], case: str | None, b: int, seed: int) -> DataFrame:
    """attribute, level, n_pos, n_neg, auc, route, ci_lo, ci_hi, reason: each level's area with the interval of its route.

    ``areas`` is auroc() of the same rows by attribute and level.  With ``case`` all levels are resampled by whole cases,
    else the levels of a small class by rows; the others keep DeLong's interval.  Only levels that are sent are unfolded.
    """
    at = ["attribute", "level"]
    out = area_routes(ranks.auroc_interval(areas), case is not None)
    long = counts.unfold(rows.where("score is not null"), attributes, ["y", "score", *([case] if case else [])])
    if case:
        drawn = resample.bootstrap_clustered_auroc(long, case, at, b, seed)
    else:
        drawn = resample.bootstrap_auroc(long.join(out.where("route = 'row_bootstrap'").select(*at), at, "left_semi"), at, b, seed)
    out = out.join(drawn.select(*at, F.col("ci_lo").alias("b_lo"), F.col("ci_hi").alias("b_hi"), F.col("reason").alias("b_reason")), at, "left")
    own = F.col("route") == "delong"
    pick = lambda mine, theirs: F.when(own, F.col(mine)).otherwise(F.col(theirs))
    lacking = F.when(~own & (F.least("n_pos", "n_neg") == 0), "single_class").otherwise(pick("reason", "b_reason"))
    return out.select(*at, "n_pos", "n_neg", "auc", "route", pick("ci_lo", "b_lo").alias("ci_lo"), pick("ci_hi", "b_hi").alias("ci_hi"), lacking.alias("reason"))


def area_companions(areas: DataFrame) -> DataFrame:
    """Adds both DeLong intervals of an area and whether Wald's had to be clipped to [0, 1]."""
    z, a, se = ci.z_for(), F.col("auc"), F.col("se")
    ok = (F.least("n_pos", "n_neg") >= 2) & (a > 0) & (a < 1) & (se > 0)
    lo, hi = ci.logit_bounds(a, F.try_divide(se, a * (1 - a)))
    given = {"wald_lo": ci.clip(a - z * se), "wald_hi": ci.clip(a + z * se), "logit_lo": lo, "logit_hi": hi, "clipped": (a - z * se < 0) | (a + z * se > 1)}
    return areas.withColumns({k: F.when(ok, v) for k, v in given.items()})


def precision_tiers(cells: DataFrame) -> DataFrame:
    """Adds tiers: all that apply to a with_wilson() cell, the gravest first, joined by commas."""
    events = F.least("k", F.col("n") - F.col("k"))
    tier = F.when(F.col("n") < 10, "not_evaluable_shown_for_transparency").when((F.col("n") < 30) | (events < 5), "very_low_precision")
    wide = F.when((F.col("ci_hi") - F.col("ci_lo")) / 2 > 0.10, "wide_interval")
    return cells.withColumn("tiers", F.concat_ws(",", tier, wide))


def fairness_rows(d: Declarations, gaps: DataFrame, references: DataFrame) -> DataFrame:
    """evaluate() of the declared fairness bound at every operating point and level that has a gap.

    gaps: CELL columns of the fairness attribute.  Without a bound, or without gaps, there is no row.
    """
    f = d.fairness or {}
    if f.get("bound") in (None, "", "null"):
        return evaluate(gaps.select(F.lit("").alias("id"), "quantity", "attribute", "level", "op", "metric", F.lit("").alias("statistic"), F.lit("").alias("comparator"), F.lit(0.0).alias("value")).where("false"), gaps, references)
    asked = gaps.where((F.col("attribute") == f["attribute"]) & (F.col("metric") == f["criterion_of_interest"]) & (F.col("level") != UNKNOWN)).select("quantity", "attribute", "level", "op", "metric").distinct()
    return evaluate(asked.withColumns({"id": F.lit(f"fairness:{f['criterion_of_interest']}"), "statistic": F.lit(f["statistic"]), "comparator": F.lit(f["comparator"]), "value": F.lit(float(f["bound"]))}), gaps, references)


def clustered_mcnemar(cells: DataFrame) -> DataFrame:
    """McNemar's test refused for rows in cases: f and g stay, statistic and p are null, with the reason."""
    none = F.lit(None).cast("double")
    return cells.withColumns({"statistic": none, "p": none, "reason": F.lit("clustered_data_analytic_ci_invalid")})


def ipa_interval(brier: DataFrame, prevalence: DataFrame, keys: list[str]) -> DataFrame:
    """The index of accuracy of a bootstrap_brier() table: draws keep the outcomes, so its reference score is fixed."""
    ref = F.col("rate") * (1 - F.col("rate"))
    out = brier.join(prevalence, keys)
    turned = lambda c: F.when(ref > 0, 1 - F.col(c) / ref)
    return out.select(*keys, "n", ref.alias("brier_ref"), F.lit("fixed_by_outcome_stratification").alias("brier_ref_reason"), turned("est").alias("ipa"), turned("ci_hi").alias("ci_lo"), turned("ci_lo").alias("ci_hi"), "reason")
