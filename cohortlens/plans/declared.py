"""Queries of declaration-driven analyses and composed blocks, registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import intervals as ci
from cohortlens.operators import calibration, compare, counts, criteria, declared, ranks, resample
from cohortlens.plans import queries as q
from cohortlens.plans.cohorts import ATTRIBUTES, BANDS, LONG_SQL, POINTS, SHIPMENTS_SQL, VISITS_SQL, analysed, shipments, table, visits
from cohortlens.plans.queries import ORACLES, Z, query, rounded
from cohortlens.sources import declare, ingest

#: A lower-is-positive model with a declared reference level, limits and criteria.
DECLARED = declare.parse("""
schema_version: 1
model: {name: returns, version: 1.10}
task: binary
classes: {positive: R, negative: N}
score: {type: probability, orientation: lower_is_positive}
operating_points:
- {id: op1, threshold: 0.5, rule: "<=", provenance: other}
- {id: op2, threshold: 0.3, rule: "<", provenance: other}
reference_standard: {type: comparator, description: d}
indeterminates: {policy: none_present, values: [A]}
clustering: {unit: case_id}
prevalence: [{label: here, value: 0.5}]
subgroups:
- {attribute: segment, prespecified: true, reference_level: MACHINERY}
- {attribute: status, prespecified: true, reference_level: largest}
egress: {suppression: {min_n: 400, min_events: 60, min_nonevents: 20}}
bootstrap: {B: 500, seed: 7}
""")
_r = q._r


@query(f"with {LONG_SQL}, hist as (select attribute, level, -score as s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from long group by all), {q._PLACED} select attribute, level, n_pos, n_neg, {_r('auc')} as auc, {_r('se')} as se from areas")
def declared_auroc(spark, sf_dir):
    """Areas of a score that falls with the positive class."""
    a = declared.oriented(analysed(spark, sf_dir), DECLARED).groupBy(*ATTRIBUTES, "rank_score", "y").agg(F.count("*").alias("c"))
    long = counts.unfold(a, ATTRIBUTES, ["rank_score", "y", "c"])
    h = long.groupBy("attribute", "level", F.col("rank_score").alias("s")).agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("q"))
    return rounded(ranks.areas(h, ["attribute", "level"]))


def _declared_cells(spark, sf_dir):
    return counts.proportions(counts.two_by_two(analysed(spark, sf_dir), ATTRIBUTES, declared.points_of(DECLARED, scored=True)))


_LOWER = {">= 0.5": "<= 0.5", "> 0.7": "< 0.3"}


def _lowered(sql: str) -> str:
    return sql.replace("score >= 0.5", "score <= 0.5").replace("score > 0.7", "score < 0.3")


@query(_lowered(ORACLES["proportion_differences"]).replace(q._REFERENCE_SQL, q._REFERENCE_SQL.replace("select attribute, level as reference", "select attribute, case attribute when 'segment' then 'MACHINERY' else level end as reference")))
def declared_differences(spark, sf_dir):
    """Differences at <= and < points, against a declared reference level."""
    cells = _declared_cells(spark, sf_dir)
    sizes = cells.where("metric = 'accuracy' and op = 'op1'").select("attribute", "level", "n")
    return rounded(counts.differences(cells, declared.reference_levels(sizes.where("attribute <> 'overall'"), DECLARED)))


@query(_lowered(ORACLES["suppressed_cells"]).replace(q._HIDE, "(coalesce(n < 400 or k < 60 or n - k < 20, true))"))
def declared_suppression(spark, sf_dir):
    return rounded(criteria.project(counts.with_wilson(_declared_cells(spark, sf_dir)), DECLARED.suppression))


_RAW_SQL = "raw as (select l_orderkey, case when l_linenumber = 7 and l_quantity > 45 then null else l_orderkey::varchar end as case_id, l_returnflag as y_true, case when l_tax = 0.08 then '1e999' when l_tax = 0.07 then 'high' else l_discount::varchar end as score, case when l_quantity < 2 then 'train' when l_quantity < 3 then 'valid' else 'test' end as dataset, case when l_linenumber = 6 then 'a' || chr(7) else 'a' end as attr_note from lineitem)"


@query(
    f"with {_RAW_SQL} select 0 as step, 'S01' as code, 'y_true' as role, 0::bigint as n, false as halts union all select 1, 'S01', 'score', 0, false union all select 2, 'S02', 'any', count(*) filter (contains(attr_note, chr(7))), count(*) filter (contains(attr_note, chr(7))) > 0 from raw "
    "union all select 3, 'S02', 'score', count(*) filter (score in ('1e999', 'high')), count(*) filter (score in ('1e999', 'high')) > 0 from raw union all select 4, 'S05', 'case_id', count(*) filter (case_id is null), count(*) filter (case_id is null) > 0 from raw union all select 5, 'S03', 'period', 1, true union all select 6, 'S02', 'dataset', count(distinct dataset) - 1, count(distinct dataset) > 1 from raw"
)
def input_checks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45), None).otherwise(F.col("l_orderkey").cast("string")).alias("case_id"), F.col("l_returnflag").alias("y_true"),
        F.when(F.round("l_tax", 2) == 0.08, "1e999").when(F.round("l_tax", 2) == 0.07, "high").otherwise(F.col("l_discount").cast("string")).alias("score"),
        F.when(F.col("l_quantity") < 2, "train").when(F.col("l_quantity") < 3, "valid").otherwise("test").alias("dataset"), F.when(F.col("l_linenumber") == 6, "a\x07").otherwise("a").alias("attr_note"),
    )
    return declared.input_checks(raw, period="shipped")


@query(
    f"with {LONG_SQL}, counts as (select attribute, level, 'op1' as op, count(*) filter (y = 1 and p) as tp, count(*) filter (y = 1 and not p) as fn, count(*) filter (y = 0 and p) as fp, count(*) filter (y = 0 and not p) as tn from (select attribute, level, y, l as p from (select *, prior >= 0.5 as l from long)) group by all) select * from counts"
)
def predicted_only_counts(spark, sf_dir):
    """2 x 2 tables of a table with predictions and no score."""
    one = declare.Declarations("m", "1", "yes", "no", True, True, (POINTS[0],))
    a = analysed(spark, sf_dir).withColumns({"y_pred": F.when(F.col("prior") >= 0.5, "yes").otherwise("no"), "score": F.lit(None).cast("double")})
    return counts.two_by_two(a, ATTRIBUTES, declared.points_of(one, scored=False))


@query(f"with {SHIPMENTS_SQL} select count(*) filter (l_quantity is null) as n_missing, count(*) filter (l_quantity >= 50 or l_quantity < 0) as n_outside from lineitem")
def band_losses(spark, sf_dir):
    return declared.band_losses(table(spark, sf_dir, "lineitem"), "l_quantity", BANDS)


@query(ORACLES["flow_waterfall"].replace(" from shipments", ", count(distinct segment) filter (flow_state = 'analysed') as n_sites, count(distinct case_id) filter (flow_state = 'analysed') < count(*) filter (flow_state = 'analysed') as clustered, case when count(distinct case_id) filter (flow_state = 'analysed') < count(*) filter (flow_state = 'analysed') then 'detected' else 'none' end as route from shipments").replace("from shipments)", "from shipments)"))
def flow_block(spark, sf_dir):
    return declared.flow_block(shipments(spark, sf_dir), "case_id", "segment")


@query(
    f"with {SHIPMENTS_SQL}, l as ({' union all '.join(f'''select '{a}' as attribute, coalesce({a}, 'Unknown/missing') as level, flow_state from shipments''' for a in ATTRIBUTES)}), t as (select attribute, level, count(*) filter (flow_state = 'analysed') as n, count(*) filter (flow_state = 'dev') as n_dev from l group by all having count(*) filter (flow_state in ('analysed', 'dev')) > 0) "
    f"select attribute, level, row_number() over (partition by attribute order by level = 'Unknown/missing', level) as position, n, n_dev, {_r('100.0 * n / nullif(sum(n) over (partition by attribute), 0)')} as pct, {_r('100.0 * n_dev / nullif(sum(n_dev) over (partition by attribute), 0)')} as pct_dev from t"
)
def table_one_both(spark, sf_dir):
    """Table 1 of the analysed and the development rows, levels in order, missing values last."""
    return rounded(declared.table_one(shipments(spark, sf_dir), ATTRIBUTES, F.col("flow_state") == "dev", F.col("flow_state") == "analysed"))


@query(f"with {VISITS_SQL} select case_id, row_number() over (order by min(event_id)) - 1 as place from visits where case_id is not null group by case_id")
def first_appearance(spark, sf_dir):
    return declared.first_appearance(visits(spark, sf_dir), "case_id", "event_id")


_PAIRS_SQL = LONG_SQL + ", pairs as (select * from long where prior is not null)"


def _by_level_sql() -> str:
    """Paired cells of the shipments, by level; the same differences as of the visits."""
    parts = []
    for op, rule in (("op1", ">= 0.5"), ("op2", "> 0.7")):
        a, b = f"(score {rule})", f"(prior {rule})"
        for m, w, x, y in (("sensitivity", "y = 1", a, b), ("specificity", "y = 0", f"not {a}", f"not {b}"), ("accuracy", "true", f"{a} = (y = 1)", f"{b} = (y = 1)")):
            parts.append(f"select attribute, level, '{op}' as op, '{m}' as metric, count(*) filter ({w} and ({x}) and ({y})) as e, count(*) filter ({w} and ({x}) and not ({y})) as f, count(*) filter ({w} and not ({x}) and ({y})) as g, count(*) filter ({w} and not ({x}) and not ({y})) as h from pairs group by attribute, level")
    body = q._paired_diff_sql().split(", a as (select *, e + f + g + h", 1)[1]
    return f"with {_PAIRS_SQL}, pc as ({' union all '.join(parts)}), a as (select *, e + f + g + h{body}".replace("select cohort, op,", "select attribute, level, op,")


def _paired_levels(spark, sf_dir):
    pairs = analysed(spark, sf_dir).where("prior is not null")
    return compare.paired_differences(declared.paired_by_level(pairs, POINTS, ATTRIBUTES))


@query(_by_level_sql())
def paired_by_level(spark, sf_dir):
    return rounded(_paired_levels(spark, sf_dir))


@query(
    f"with {_PAIRS_SQL}, "
    + ", ".join(
        f"h{i} as (select attribute, level, {c} as s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from pairs group by all), w{i} as (select attribute, level, s, (coalesce(sum(q) over o, 0) + q / 2.0) / nullif(sum(q) over k, 0) as v10, 1 - (coalesce(sum(p) over o, 0) + p / 2.0) / nullif(sum(p) over k, 0) as v01 from h{i} window k as (partition by attribute, level), o as (partition by attribute, level order by s rows between unbounded preceding and 1 preceding))"
        for i, c in ((1, "score"), (2, "prior"))
    )
    + ", j as (select l.attribute, l.level, y, a.v10 as a10, b.v10 as b10, a.v01 as a01, b.v01 as b01 from pairs l join w1 a on l.score = a.s and l.attribute = a.attribute and l.level = a.level join w2 b on l.prior = b.s and l.attribute = b.attribute and l.level = b.level), "
    "m as (select attribute, level, count(*) filter (y = 1) as np, count(*) filter (y = 0) as nq, avg(a10) filter (y = 1) as auc_new, avg(b10) filter (y = 1) as auc_prior, var_samp(a10 - b10) filter (y = 1) / count(*) filter (y = 1) + var_samp(a01 - b01) filter (y = 0) / count(*) filter (y = 0) as v from j group by all) "
    f"select attribute, level, np as n_pos, nq as n_neg, {_r('auc_new')} as auc_new, {_r('auc_prior')} as auc_prior, {_r('auc_new - auc_prior')} as est, {_r(f'auc_new - auc_prior - {Z!r} * sqrt(v)')} as ci_lo, {_r(f'auc_new - auc_prior + {Z!r} * sqrt(v)')} as ci_hi from m"
)
def paired_delong_by_level(spark, sf_dir):
    pairs = counts.unfold(analysed(spark, sf_dir).where("prior is not null"), ATTRIBUTES, ["y", "score", "prior"])
    return rounded(ranks.paired_delong(pairs, ["attribute", "level"]).select("attribute", "level", "n_pos", "n_neg", "auc_new", "auc_prior", "est", "ci_lo", "ci_hi"))


_REST_SQL = f"{q._HIST} {q._PLACED}, whole as (select attribute, s, sum(p) as ap, sum(q) as aq from hist group by all), lv as (select distinct attribute, level from hist where attribute <> 'overall'), rest as (select * from (select lv.attribute, lv.level, w.s, ap - coalesce(p, 0) as p, aq - coalesce(q, 0) as q from lv join whole w using (attribute) left join hist h on h.attribute = lv.attribute and h.level = lv.level and h.s = w.s) where p + q > 0), "
_REST_PLACED = q._PLACED.replace("from hist", "from rest").replace("v as (", "rv as (").replace("u as (", "ru as (").replace("from v)", "from rv)").replace("areas as (", "rareas as (").replace("from u ", "from ru ")


@query(
    f"with {_REST_SQL} {_REST_PLACED}, d as (select a.attribute, a.level, least(a.n_pos, b.n_pos) as mp, least(a.n_neg, b.n_neg) as mn, a.auc - b.auc as est, sqrt(a.se * a.se + b.se * b.se) as sd, a.se = 0 or b.se = 0 as flat from areas a join rareas b on b.attribute = a.attribute and b.level = a.level), r as (select *, case when mp < 10 then 'insufficient_positives' when mn < 10 then 'insufficient_negatives' when flat then 'boundary_estimate' end as reason from d) "
    f"select attribute, level, {_r('case when mp >= 10 and mn >= 10 then est end')} as est, {_r(f'case when reason is null then est - {Z!r} * sd end')} as ci_lo, {_r(f'case when reason is null then est + {Z!r} * sd end')} as ci_hi, reason from r"
)
def auroc_against_rest(spark, sf_dir):
    """Each level's area less that of all other rows."""
    at = ["attribute", "level"]
    h = q._long(spark, sf_dir).groupBy(*at, F.col("score").alias("s")).agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("q"))
    out = compare.unpaired_areas(ranks.areas(h, at), declared.complement_areas(h), at)
    return rounded(out.select(*at, "est", "ci_lo", "ci_hi", "reason"))


@query(f"with {LONG_SQL} select attribute, level, count(*) as n, {_r('avg(pow(score - y, 2))')} as brier from long group by all")
def brier_by_level(spark, sf_dir):
    h = analysed(spark, sf_dir).groupBy(*ATTRIBUTES).agg(F.count("*").alias("n"), F.sum((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("loss"))
    long = counts.unfold(h, ATTRIBUTES, ["n", "loss"]).groupBy("attribute", "level").agg(F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("brier"))
    return rounded(long)


@query(f"with {SHIPMENTS_SQL}, {q._CAL} select 'all' as cohort, n, events, {_r('events / expected')} as oe, {_r('brier')} as brier, least(events, n - events) < 200 as few, null::varchar as reason, 'higher' as orientation from c union all select 'all', n, events, null, null, least(events, n - events) < 200, 'calibration_suppressed', 'lower' from c")
def calibration_blocks(spark, sf_dir):
    """The calibration block of a probability, and of a score that is none."""
    s = calibration.summary(analysed(spark, sf_dir).withColumn("cohort", F.lit("all")), ["cohort"])
    plain = declare.Declarations("m", "1", "1", "0", True, True, (POINTS[0],))
    out = declared.calibration_block(s, plain).withColumn("orientation", F.lit("higher")).unionByName(declared.calibration_block(s, DECLARED).withColumn("orientation", F.lit("lower")))
    return rounded(out.select("cohort", "n", "events", "oe", "brier", "few", "reason", "orientation"))


_HITS_SQL = LONG_SQL + ", hits as (" + " union all ".join(
    f"select attribute, level, '{m}' as metric, case_id, ({h})::int as hit from long where {w}"
    for m, w, h in (("sensitivity", "y = 1", "score >= 0.5"), ("specificity", "y = 0", "not score >= 0.5"), ("ppv", "score >= 0.5", "y = 1"), ("npv", "not score >= 0.5", "y = 0"), ("accuracy", "true", "(score >= 0.5) = (y = 1)"))
) + "), units as (select attribute, level, metric, case_id, count(*) as m, sum(hit) as u from hits group by all)"
_ROUTED_SQL = ORACLES["design_effects"].split(", s as (select metric, segment,", 1)[1].replace("metric, segment,", "metric, attribute, level,")


def _routed(spark, sf_dir):
    keys = ["metric", "attribute", "level"]
    kinds = counts.kinds(declared.hits_by_level(analysed(spark, sf_dir), "case_id", ATTRIBUTES, POINTS[0]), keys)
    return kinds, counts.design_effect_of(kinds, keys)


@query(f"with {_HITS_SQL}, s as (select metric, attribute, level,{_ROUTED_SQL}")
def clustered_subgroups(spark, sf_dir):
    """Every level's proportions on rows in cases: the route each takes and, by design effect, its interval."""
    return rounded(_routed(spark, sf_dir)[1])


@query()
def clustered_intervals(spark, sf_dir):
    """The same with the intervals of the cells that are sent to the bootstrap (whole cases drawn)."""
    keys = ["metric", "attribute", "level"]
    kinds, cells = _routed(spark, sf_dir)
    sent = cells.where("route in ('case_share_above_grid', 'rows_per_case_above_grid')").select(*keys)
    drawn = resample.bootstrap_kinds(kinds.join(sent, keys, "left_semi"), keys, DECLARED.resamples, DECLARED.seed)
    out = cells.join(drawn.select(*keys, F.col("ci_lo").alias("b_lo"), F.col("ci_hi").alias("b_hi"), F.col("reason").alias("b_reason")), keys, "left")
    reason = F.when(F.col("route").isin("not_estimable", "below_coverage_bar"), "fewer_than_five_cases").otherwise(F.col("b_reason"))
    flag = F.when(F.col("cases") >= 5, "clustered_coverage_not_established")
    return rounded(out.select(*keys, "cases", "n", "k", "route", "est", F.coalesce("ci_lo", "b_lo").alias("ci_lo"), F.coalesce("ci_hi", "b_hi").alias("ci_hi"), reason.alias("reason"), flag.alias("flag")))


@query()
def clustered_areas(spark, sf_dir):
    """Every level's area on rows in cases, its interval from whole cases drawn."""
    out = declared.routed_areas(analysed(spark, sf_dir), q._areas(spark, sf_dir), ATTRIBUTES, "case_id", DECLARED.resamples, DECLARED.seed)
    return rounded(out)


@query()
def routed_areas(spark, sf_dir):
    """Every level's area on independent rows: levels with under ten rows of a class by rows drawn, the others by DeLong."""
    return rounded(declared.routed_areas(analysed(spark, sf_dir), q._areas(spark, sf_dir), ATTRIBUTES, None, DECLARED.resamples, DECLARED.seed))


_LOGS = "'lr_pos', 'lr_neg', 'dor'"


@query(
    f"with m as ({ORACLES['metric_family']}), a as ({ORACLES['auroc_intervals']}) select op, metric, est, ci_lo, ci_hi, case when metric in ('f1', 'mcc') then 'analytic_ci_unavailable' when est is null and metric in ({_LOGS}) then 'zero_cell_log_undefined' when est is null then 'zero_denominator' end as reason from m where attribute = 'overall' "
    "union all select null, 'auroc', auc, ci_lo, ci_hi, reason from a where attribute = 'overall'"
)
def overall_block(spark, sf_dir):
    """All metrics of the whole cohort: thirteen at each operating point, and the area."""
    family = counts.metric_family(q._counts(spark, sf_dir)).where("attribute = 'overall'")
    none = F.when(F.col("metric").isin("f1", "mcc"), "analytic_ci_unavailable").when(F.col("est").isNull() & F.col("metric").isin("lr_pos", "lr_neg", "dor"), "zero_cell_log_undefined").when(F.col("est").isNull(), "zero_denominator")
    area = ranks.auroc_interval(q._areas(spark, sf_dir).where("attribute = 'overall'"))
    out = family.select("op", "metric", "est", "ci_lo", "ci_hi", none.alias("reason"))
    return rounded(out.unionByName(area.select(F.lit(None).cast("string").alias("op"), F.lit("auroc").alias("metric"), F.col("auc").alias("est"), "ci_lo", "ci_hi", "reason")))


_REFUSED = ", ".join(f"'{m}'" for m in declared.NO_CLUSTERED_INTERVAL)


@query(
    f"with m as ({ORACLES['metric_family']}), c as ({ORACLES['clustered_subgroups']}) select metric, est, ci_lo, ci_hi, route from c where attribute = 'overall' union all select metric, est, null, null, 'clustered_data_analytic_ci_invalid' from m where attribute = 'overall' and op = 'op1' and metric in ({_REFUSED})"
)
def clustered_overall_block(spark, sf_dir):
    """The overall block of rows in cases: proportions by their route, the other metrics without an interval."""
    routed = _routed(spark, sf_dir)[1].where("attribute = 'overall'").select("metric", "est", "ci_lo", "ci_hi", "route")
    family = counts.metric_family(q._counts(spark, sf_dir)).where((F.col("attribute") == "overall") & (F.col("op") == "op1") & F.col("metric").isin(*declared.NO_CLUSTERED_INTERVAL))
    refused = family.select("metric", "est", F.lit(None).cast("double").alias("ci_lo"), F.lit(None).cast("double").alias("ci_hi"), F.lit("clustered_data_analytic_ci_invalid").alias("route"))
    return rounded(routed.unionByName(refused))


CRITERIA = [
    ("K1", "value", "overall", "all", "op1", "sensitivity", "ci_lower_bound", ">=", 0.3),
    ("K2", "value", "segment", "*", "op2", "specificity", "estimate", ">", 0.2),
    ("K3", "value", "overall", "all", None, "auroc", "ci_lower_bound", ">", 0.49),
    ("K4", "value", "segment", "*", None, "auroc", "ci_upper_bound", "<=", 0.52),
    ("K5", "value", "overall", "all", None, "oe", "ci_upper_bound", "<", 1.2),
    ("K6", "value", "overall", "all", None, "brier", "estimate", "<", 0.5),
    ("K7", "value", "segment", "BUILDING", None, "oe", "estimate", "<", 1.2),
    ("K8", "value", "segment", "*", "op1", "tpr_gap", "ci_lower_bound", ">=", -0.1),
    ("K9", "value", "segment", "*", None, "auroc_gap", "estimate", ">=", -0.05),
    ("K10", "value", "status", "F", "op1", "tpr_gap", "estimate", ">=", -0.1),
    ("K11", "value", "segment", "NOWHERE", "op1", "npv", "estimate", ">=", 0.1),
    ("K12", "paired_difference_vs_prior", "overall", "all", "op1", "sensitivity", "ci_lower_bound", ">=", -0.05),
    ("K13", "paired_difference_vs_prior", "priority", "*", "op2", "accuracy", "ci_lower_bound", ">", -0.4),
    ("K14", "paired_difference_vs_prior", "overall", "all", "op1", "ppv", "estimate", ">=", 0.0),
    ("K15", "value", "status", "*", "op1", "sensitivity", "ci_lower_bound", ">=", 0.99999),
]
_SCHEMA = "id string, quantity string, attribute string, level string, op string, metric string, statistic string, comparator string, value double"
_CRITERIA_SQL = ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in c) + ")" for c in CRITERIA)
_SMALL = "coalesce(n < 600 or k < 5 or n - k < 5, true)"


@query(
    f"""with cr as (select * from (values {_CRITERIA_SQL}) v(id, quantity, attribute, level, op, metric, statistic, comparator, value)),
pw as ({ORACLES['subgroup_proportions']}), au as ({ORACLES['auroc_intervals']}), gp as ({ORACLES['fairness_gaps']}), ag as ({ORACLES['auroc_differences']}), pl as ({ORACLES['paired_by_level']}), cs as ({ORACLES['calibration_summary']}), rf as ({ORACLES['reference_levels']}),
cells as (select 'value' as quantity, attribute, level, op, metric, n, est, ci_lo, ci_hi, {_SMALL} as suppressed from pw
 union all select 'value', attribute, level, null, 'auroc', null, auc, ci_lo, ci_hi, false from au union all select 'value', 'overall', 'all', null, 'oe', null, oe, oe_lo, oe_hi, false from cs union all select 'value', 'overall', 'all', null, 'brier', null, brier, null, null, false from cs
 union all select 'value', 'segment', level, op, gap, null, est, ci_lo, ci_hi, false from gp union all select 'value', 'segment', level, null, 'auroc_gap', null, est, ci_lo, ci_hi, false from ag where attribute = 'segment'
 union all select 'paired_difference_vs_prior', attribute, level, op, metric, n, est, ci_lo, ci_hi, false from pl),
lv as (select distinct attribute, level from cells), rows as (select * from cr where level <> '*' union all select id, quantity, cr.attribute, coalesce(lv.level, cr.level), op, metric, statistic, comparator, value from cr left join lv on lv.attribute = cr.attribute and lv.level <> 'Unknown/missing' where cr.level = '*'),
j as (select r.*, c.n, c.est, c.ci_lo, c.ci_hi, c.suppressed, c.metric is not null as known, lv.level is not null as tabulated, rf.reference, r.quantity <> 'value' as paired from rows r left join cells c on c.quantity = r.quantity and c.attribute = r.attribute and c.level = r.level and c.op is not distinct from r.op and c.metric = r.metric left join lv on lv.attribute = r.attribute and lv.level = r.level left join rf on rf.attribute = r.attribute),
s as (select *, case statistic when 'estimate' then est when 'ci_lower_bound' then ci_lo else ci_hi end as st from j),
t as (select *, case when not known and paired and metric in ('ppv', 'npv') then 'metric_not_compared' when not tabulated then 'level_absent' when not known and paired then 'comparison_not_computed_for_scope' when not known and ends_with(metric, '_gap') and level = reference then 'level_is_reference' when not known and ends_with(metric, '_gap') then 'gap_requires_fairness_attribute'
 when not known and attribute <> 'overall' and metric in (select metric from cells where attribute = 'overall' and quantity = 'value') then 'metric_not_computed_for_scope' when not known then 'metric_not_computed' when suppressed then 'suppressed' when ci_lo is null or st is null then 'no_interval' else 'statistic_compared' end as reason,
 case comparator when '>=' then st >= value when '>' then st > value when '<=' then st <= value else st < value end as holds, metric in ('sensitivity', 'specificity', 'ppv', 'npv', 'accuracy') and statistic = 'ci_lower_bound' and comparator in ('>=', '>') and not paired and n > 0 as bound from s)
select id, attribute, level, op, metric, case when reason = 'statistic_compared' then {_r('st')} end as stat, case when reason <> 'statistic_compared' then 'not_assessable' when holds then 'met' else 'not_met' end as status, reason, {_r(f'case when bound then n / (n + {Z * Z!r}) end')} as most_attainable, case when bound then case comparator when '>=' then n / (n + {Z * Z!r}) >= value else n / (n + {Z * Z!r}) > value end end as attainable from t"""
)
def criteria_evaluation(spark, sf_dir):
    """Criteria on proportions, areas, calibration, gaps and paired differences, of one level or every one."""
    own, areas = counts.with_wilson(q._cells(spark, sf_dir)), ranks.auroc_interval(q._areas(spark, sf_dir))
    summary = calibration.summary(analysed(spark, sf_dir).withColumn("attribute", F.lit("overall")).withColumn("level", F.lit("all")), ["attribute", "level"])
    segment, at = F.lit("segment"), {"attribute": F.lit("segment")}
    gaps, area_gaps, paired = q.fairness_gaps(spark, sf_dir), q.auroc_differences(spark, sf_dir).where(F.col("attribute") == segment), _paired_levels(spark, sf_dir)
    hide = criteria.suppressed(F.col("n"), F.col("k"), F.col("n") - F.col("k"), (600, 5, 5))
    parts = [
        declared.cells_of(own, suppressed=hide), declared.cells_of(areas, metric=F.lit("auroc"), est=F.col("auc"), n=F.lit(None).cast("long")),
        declared.cells_of(summary, metric=F.lit("oe"), est=F.col("oe"), ci_lo=F.col("oe_lo"), ci_hi=F.col("oe_hi"), n=F.lit(None).cast("long")), declared.cells_of(summary, metric=F.lit("brier"), est=F.col("brier"), n=F.lit(None).cast("long")),
        declared.cells_of(gaps, metric=F.col("gap"), **at), declared.cells_of(area_gaps, metric=F.lit("auroc_gap"), n=F.lit(None).cast("long")), declared.cells_of(paired, quantity=F.lit("paired_difference_vs_prior")),
    ]
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    cells = cells.select(*[ci.rounded(F.col(c)).alias(c) if c in ("est", "ci_lo", "ci_hi") else c for c in declared.CELL])
    return rounded(declared.evaluate(spark.createDataFrame(CRITERIA, _SCHEMA), cells, q.reference_levels(spark, sf_dir)))


_ROLES = {"l_returnflag": "y_true", "l_discount": "score", "l_orderkey": "case_id", "l_shipdate": "event_date", "l_linestatus": "attr_status", "l_comment": "ignored", "l_tax": "ignored"}


@query(
    f"with f as ({ORACLES['flow_block']}) select f.*, sha256(array_to_string(list_sort(['l_returnflag', 'l_discount', 'l_orderkey', 'l_shipdate', 'l_linestatus', 'l_comment', 'l_tax']), chr(10))) as headers_sha256, 'attr_status,case_id,event_date,score,y_true' as roles_present, 2::bigint as n_unused_columns, 0::bigint as n_rater_columns, 'segment,status' as attributes, 'R' as positive, 'lower_is_positive' as orientation, 'op1,op2' as points from f"
)
def ingest_report(spark, sf_dir):
    rows = shipments(spark, sf_dir)
    return declared.ingest_report(rows, DECLARED, _ROLES, declared.flow_block(rows, "case_id", "segment"))


@query(
    f"with {q._HIST} {q._PLACED} select attribute, level, n_pos, n_neg, {_r('auc')} as auc, case when least(n_pos, n_neg) < 10 then 'row_bootstrap' else 'delong' end as route, case when least(n_pos, n_neg) < 10 then 'replaced_small_class' when auc > 0 and auc < 1 and se > 0 then 'used' else 'unavailable' end as analytic from areas"
)
def auroc_routes(spark, sf_dir):
    return rounded(declared.area_routes(q._areas(spark, sf_dir), clustered=False).drop("se"))


@query(
    f"with {q._HIST} {q._PLACED}, b as (select *, least(n_pos, n_neg) >= 2 and auc > 0 and auc < 1 and se > 0 as ok, ln(auc / nullif(1 - auc, 0)) as eta, se / nullif(auc * (1 - auc), 0) as el from areas) select attribute, level, {_r('auc')} as auc, "
    f"{_r(f'case when ok then least(greatest(auc - {Z!r} * se, 0), 1) end')} as wald_lo, {_r(f'case when ok then least(greatest(auc + {Z!r} * se, 0), 1) end')} as wald_hi, {_r(f'case when ok then 1 / (1 + exp(-(eta - {Z!r} * el))) end')} as logit_lo, {_r(f'case when ok then 1 / (1 + exp(-(eta + {Z!r} * el))) end')} as logit_hi, case when ok then auc - {Z!r} * se < 0 or auc + {Z!r} * se > 1 end as clipped from b"
)
def auroc_companions(spark, sf_dir):
    return rounded(declared.area_companions(q._areas(spark, sf_dir)).drop("n_pos", "n_neg", "se"))


@query(
    f"with {q.CELLS_SQL}, w as (select *, {q._LO} as lo, {q._HI} as hi from cells) select attribute, level, op, metric, n, concat_ws(',', case when n < 10 then 'not_evaluable_shown_for_transparency' when n < 30 or least(k, n - k) < 5 then 'very_low_precision' end, case when n > 0 and (hi - lo) / 2 > 0.10 then 'wide_interval' end) as tiers from w"
)
def precision_tiers(spark, sf_dir):
    return declared.precision_tiers(counts.with_wilson(q._cells(spark, sf_dir))).select("attribute", "level", "op", "metric", "n", "tiers")


_SIDE_AREA = q._PLACED.replace("attribute, level", "side").replace("partition by side, side", "partition by side")


@query(
    f"with {VISITS_SQL}, hist as (select event_id % 2 as side, case event_id % 2 when 0 then score else prior end as s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from visits where case event_id % 2 when 0 then score else prior end is not null group by 1, 2), {_SIDE_AREA} "
    f"select 'not_like_for_like' as flag, {_r('a.auc')} as auc_new, {_r('b.auc')} as auc_prior, {_r('a.auc - b.auc')} as est, {_r(f'a.auc - b.auc - {Z!r} * sqrt(a.se * a.se + b.se * b.se)')} as ci_lo, {_r(f'a.auc - b.auc + {Z!r} * sqrt(a.se * a.se + b.se * b.se)')} as ci_hi from areas a join areas b on a.side = 0 and b.side = 1"
)
def unpaired_version_areas(spark, sf_dir):
    """Areas of two versions on different rows."""
    v = visits(spark, sf_dir).withColumn("all", F.lit("all"))
    new, prior = v.where("event_id % 2 = 0"), v.where("event_id % 2 = 1 and prior is not null").withColumn("score", F.col("prior"))
    a, b = (ranks.auroc(x.where("score is not null"), ["all"]) for x in (new, prior))
    out = compare.unpaired_areas(a, b, ["all"]).join(b.select("all", F.col("auc").alias("auc_prior")), "all")
    return rounded(out.select(F.lit("not_like_for_like").alias("flag"), F.col("auc").alias("auc_new"), "auc_prior", "est", "ci_lo", "ci_hi"))


@query(
    f"with gp as ({ORACLES['fairness_gaps']}) select 'fairness:tpr_gap' as id, 'segment' as attribute, level, op, 'tpr_gap' as metric, ci_lo as stat, case when ci_lo is null then 'not_assessable' when ci_lo >= -0.1 then 'met' else 'not_met' end as status, case when ci_lo is null then 'no_interval' else 'statistic_compared' end as reason from gp where gap = 'tpr_gap' and level <> 'Unknown/missing'"
)
def fairness_bounds(spark, sf_dir):
    """A declared bound on a gap, at every operating point and level."""
    d = declare.Declarations("m", "1", "R", "N", True, True, tuple(POINTS), fairness={"attribute": "segment", "criterion_of_interest": "tpr_gap", "statistic": "ci_lower_bound", "comparator": ">=", "bound": "-0.1"})
    gaps = declared.cells_of(q.fairness_gaps(spark, sf_dir), metric=F.col("gap"), attribute=F.lit("segment"))
    out = declared.fairness_rows(d, gaps, q.reference_levels(spark, sf_dir))
    return rounded(out.drop("most_attainable", "attainable"))


@query(f"{q._PAIRED} select op, metric, f, g, null::double as statistic, null::double as p, 'clustered_data_analytic_ci_invalid' as reason from pc")
def clustered_mcnemar(spark, sf_dir):
    cells = compare.paired_cells(q._versions(spark, sf_dir), POINTS, ["cohort"])
    return declared.clustered_mcnemar(cells).drop("cohort", "e", "h")


@query()
def bootstrap_ipa(spark, sf_dir):
    """Brier score, its fixed reference and the index of accuracy, by segment."""
    a = analysed(spark, sf_dir)
    rate = a.groupBy("segment").agg(F.avg(F.col("y").cast("double")).alias("rate"))
    return rounded(declared.ipa_interval(resample.bootstrap_brier(a, ["segment"], DECLARED.resamples, DECLARED.seed), rate, ["segment"]))


@query("select case when n >= 10 then p else '<suppressed>' end as value, n, row_number() over (order by n desc, seen) as rank from (select p_brand as p, count(*) as n, min(p_partkey) as seen from part where p_brand is not null group by 1 order by n desc, seen limit 20)")
def top_values_by_appearance(spark, sf_dir):
    return ingest.top_values(table(spark, sf_dir, "part"), "p_brand", order="p_partkey")


@query(f"with {_RAW_SQL.replace('l_orderkey, case', 'l_orderkey * 10 + l_linenumber as pos, case', 1)} select 'attr_note' as \"column\", count(*) as n, 'U+0007' as first from raw where contains(attr_note, chr(7)) having count(*) > 0")
def control_findings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("y_true"), F.when(F.col("l_linenumber") == 6, "a\x07b").otherwise("a").alias("attr_note"))
    return ingest.control_findings(raw, "pos")


def _summary_sql() -> str:
    columns = ("c_mktsegment", "c_name", "c_acctbal", "c_custkey", "half")
    base = "c as (select c_mktsegment, c_name, c_acctbal::varchar as c_acctbal, c_custkey::varchar as c_custkey, case when c_custkey % 3 = 0 then 'yes' when c_custkey <= 4 then 'rare' end as half from customer)"
    types = {"c_mktsegment": "categorical", "c_name": "string", "c_acctbal": "float", "c_custkey": "int", "half": "categorical"}
    parts = []
    for c in columns:
        free = "true" if c == "c_name" else "false"
        split = "null" if c != "half" else "(select string_agg(x, ',' order by o) from (select half || ':' || count(*) as x, 0 as o from c where half is not null group by half having count(*) >= 10 union all select '<suppressed>:' || count(*), 1 from (select half from c where half is not null group by half having count(*) < 10) having count(*) > 0))"
        rare = "0::bigint" if c == "c_name" else f"(select count(*) from (select {c} from c where {c} is not null group by 1 having count(*) < 10))"
        parts.append(f"select '{c}' as \"column\", '{types[c]}' as type, count(*) as n, count(*) - count({c}) as n_missing, round(100.0 * (count(*) - count({c})) / count(*), 2)::double as missing_pct, count(distinct {c}) as n_unique, {free} as free_text, not {free} as values_shown, {rare} as n_suppressed_values, {split} as split from c")
    return f"with {base} " + " union all ".join(parts)


@query(_summary_sql())
def column_summaries(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("half", F.when(F.col("c_custkey") % 3 == 0, "yes").when(F.col("c_custkey") <= 4, "rare"))
    return ingest.summaries(c, ["c_mktsegment", "c_name", "c_acctbal", "c_custkey", "half"])
