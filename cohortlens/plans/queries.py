"""Registered queries of the analytics operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import intervals as ci
from cohortlens.functions.special import chi2_sf, clopper_pearson, fisher_exact, two_sided_p
from cohortlens.operators import calibration, compare, counts, criteria, gates, keys, ranks, resample
from cohortlens.plans.cohorts import ATTRIBUTES, CELLS_SQL, COUNTS_SQL, LONG_SQL, POINTS, SHIPMENTS_SQL, VISITS_SQL, analysed, parts, shipments, table, visits
from cohortlens.sources import ingest
from cohortlens.streaming.windows import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Z = ci.z_for()


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[ci.rounded(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def _div(a: str, b: str) -> str:
    return f"(({a})::double / nullif(({b})::double, 0))"


def _wilson(k: str, n: str) -> tuple[str, str]:
    root = f"{Z!r} * sqrt({Z * Z!r} + 4 * ({k}) * (1 - {_div(k, n)}))"
    return tuple(f"least(greatest((2 * ({k}) + {Z * Z!r} {s} {root}) / (2 * (({n}) + {Z * Z!r})), 0), 1)" for s in "-+")


def _newcombe(k1: str, n1: str, k2: str, n2: str) -> tuple[str, str]:
    (l1, u1), (l2, u2), p1, p2 = _wilson(k1, n1), _wilson(k2, n2), _div(k1, n1), _div(k2, n2)
    lo = f"{p1} - {p2} - sqrt(pow({p1} - {l1}, 2) + pow({u2} - {p2}, 2))"
    hi = f"{p1} - {p2} + sqrt(pow({u1} - {p1}, 2) + pow({p2} - {l2}, 2))"
    guard = lambda x: f"case when ({n1}) > 0 and ({n2}) > 0 then least(greatest({x}, -1), 1) end"
    return guard(lo), guard(hi)


def _r(x: str) -> str:
    return f"round(({x})::double, 6)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.two_by_two(analysed(spark, sf_dir), ATTRIBUTES, POINTS)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.proportions(_counts(spark, sf_dir))


# --- flow and description -----------------------------------------------------------------------------


@query(f"with {SHIPMENTS_SQL} select count(*) as rows_read, {', '.join(f'''count(*) filter (flow_state = '{s}') as {s}''' for s in ('dev', 'missing_label', 'missing_score', 'indeterminate', 'analysed'))}, count(distinct case_id) filter (flow_state = 'analysed') as n_cases from shipments")
def flow_waterfall(spark, sf_dir):
    return counts.waterfall(shipments(spark, sf_dir), "case_id")


@query(f"with {LONG_SQL} select attribute, level, count(*) as n, {_r('100.0 * count(*) / sum(count(*)) over (partition by attribute)')} as pct from long where attribute <> 'overall' group by attribute, level")
def table_one(spark, sf_dir):
    return rounded(counts.table_one(analysed(spark, sf_dir), ATTRIBUTES))


@query(f"with {SHIPMENTS_SQL} " + " union all ".join(f"select '{c}' as column, count(*) - count({c}) as n_missing, count(*) as n from shipments" for c in ("y_true", "score", "prior", "status", "segment", "period")).replace("as column", 'as "column"'))
def missingness(spark, sf_dir):
    return counts.missingness(shipments(spark, sf_dir), ["y_true", "score", "prior", "status", "segment", "period"])


@query(
    f"with {VISITS_SQL}, s as (select count(*) as n, count(event_id) as ids, count(distinct event_id) as unique_ids, count(distinct y) as labels, count(ts) as days, bool_and(score between 0 and 1) as unit, count(distinct score) as scores, count(distinct event_type) as kinds from visits) "
    "select 'event_id' as \"column\", case when unique_ids = n and n > 1 then 'row_id' else 'ignored' end as role, case when unique_ids = n and n > 1 then 'medium' else 'high' end as confidence, case when unique_ids = n and n > 1 then 'values' else 'none' end as source from s "
    "union all select 'ts', case when days > 1 then 'event_date' else 'ignored' end, case when days > 1 then 'medium' else 'high' end, case when days > 1 then 'values' else 'none' end from s "
    "union all select 'event_type', 'ignored', 'high', 'none' from s "
    "union all select 'y', 'y_true', case when labels > 10 then 'low' else 'high' end, 'synonym' from s "
    "union all select 'probability', 'score', case when unit and scores > 2 then 'high' else 'low' end, 'synonym' from s"
)
def proposed_roles(spark, sf_dir):
    v = visits(spark, sf_dir).withColumnRenamed("score", "probability")
    return ingest.propose(v, ["event_id", "ts", "event_type", "y", "probability"])


@query("with c as (select c_mktsegment as x, c_acctbal::varchar as b, c_name as s from customer) select 'x' as \"column\", count(*) as n, count(*) - count(x) as n_missing, count(distinct x) as n_unique, 'categorical' as type from c union all select 's', count(*), count(*) - count(s), count(distinct s), 'string' from c")
def column_profile(spark, sf_dir):
    return ingest.profile(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("x"), F.col("c_name").alias("s")), ["x", "s"])


@query("select case when n >= 10 then p else '<suppressed>' end as value, n, row_number() over (order by n desc, p) as rank from (select p_type as p, count(*) as n from part where p_type is not null group by 1 order by n desc, p limit 20)")
def top_values(spark, sf_dir):
    return ingest.top_values(table(spark, sf_dir, "part"), "p_type")


@query(f"with {SHIPMENTS_SQL} select age_band as level, count(*) as n from shipments group by 1")
def age_bands(spark, sf_dir):
    return shipments(spark, sf_dir).groupBy(F.col("age_band").alias("level")).agg(F.count("*").alias("n"))


@query("select strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%Y-%m') as month, year(o_orderdate)::varchar || '-Q' || quarter(o_orderdate)::varchar as quarter, count(*) as n from orders group by all")
def coarsened_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").groupBy(*[ingest.coarsen(day, g).alias(g) for g in ("year", "month", "quarter")]).agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) filter (c_acctbal is null) as n_missing, 0::bigint as n_bad, round(sum(c_acctbal), 2) as total from customer")
def typed_cells(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(F.concat(F.lit("\t "), F.col("c_acctbal").cast("string"), F.lit(" ")).alias("balance"))
    return ingest.typed(raw, doubles=["balance"]).agg(F.count("*").alias("n"), F.count_if(F.col("balance").isNull()).alias("n_missing"), F.sum("n_bad").cast("long").alias("n_bad"), F.round(F.sum("balance"), 2).alias("total"))


@query("select 'c_name' as \"column\", count(*) filter (regexp_matches(c_name, '[\\x00-\\x1f\\x7f]')) as n from customer union all select 'c_mktsegment', count(*) filter (regexp_matches(c_mktsegment, '[\\x00-\\x1f\\x7f]')) from customer")
def control_characters(spark, sf_dir):
    return ingest.control_characters(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))


_DATES = ["o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"]


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("o_orderdate"), *_DATES[1:])


@query(
    "with v as (select unnest([struct_pack(c := 'o_orderdate', x := strftime(o_orderdate, '%d.%m.%Y')), struct_pack(c := 'o_orderstatus', x := o_orderstatus::varchar), struct_pack(c := 'o_orderpriority', x := o_orderpriority::varchar), struct_pack(c := 'o_totalprice', x := o_totalprice::varchar)]) as s from orders) "
    "select s.c as \"column\", coalesce(bool_and(regexp_matches(s.x, '^\\d{4}-\\d{2}-\\d{2}|^\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{4}$|^\\d{4}/\\d{2}/\\d{2}$')), false) as date_like from v group by 1"
)
def date_like_columns(spark, sf_dir):
    return ingest.date_like(_orders(spark, sf_dir), _DATES)


@query("select 'H11' as code, count(*) as n, count(*) > 0 as halts from (select 1 from orders having bool_and(regexp_matches(strftime(o_orderdate, '%d.%m.%Y'), '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$')))")
def period_gate(spark, sf_dir):
    return gates.uncovered_dates(ingest.date_like(_orders(spark, sf_dir), _DATES), "event_date")


@query(
    "with m as (select strftime(o_orderdate, '%Y-%m') as v, count(*) as n from orders where o_orderdate is not null group by 1), q as (select o_custkey as v, count(*) as n from orders where o_custkey is not null group by 1) "
    "select 'o_orderdate' as \"column\", (select case when n >= 10 then v else '<suppressed>' end from m order by v limit 1) as lowest, (select case when n >= 10 then v else '<suppressed>' end from m order by v desc limit 1) as highest "
    "union all select 'o_custkey', (select case when n >= 10 then v::double::varchar else '<suppressed>' end from q order by v limit 1), (select case when n >= 10 then v::double::varchar else '<suppressed>' end from q order by v desc limit 1) "
    "union all select 'o_orderstatus', null, null"
)
def column_extremes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_custkey", "o_orderstatus")
    return ingest.extremes(orders, ["o_orderdate", "o_custkey", "o_orderstatus"])


@query(
    "with cells as (select event_id as pos, event_type as a, (value::decimal(18, 2))::varchar as b from events), leaf as (select pos, sha256(coalesce(length(a) || ':' || a, '-') || '|' || coalesce(length(b) || ':' || b, '-')) as digest from cells), "
    f"up as (select pos // {keys.FAN} as pos, sha256(string_agg(digest, '' order by pos)) as digest from leaf group by 1) "
    f"select (select count(*) from leaf) as n, case when count(*) > 1 then sha256(string_agg(digest, '' order by pos)) else max(digest) end as key from up"
)
def set_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return keys.test_set_key(e, "event_id", [F.col("event_type"), F.col("value").cast("decimal(18, 2)").cast("string")], e.count())


# --- counts and proportions ---------------------------------------------------------------------------


@query(f"with {COUNTS_SQL} select * from counts")
def confusion_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


_LO, _HI = _wilson("k", "n")


@query(f"with {CELLS_SQL}, w as (select *, {_div('k', 'n')} as est, case when n > 0 then {_LO} end as lo, case when n > 0 then {_HI} end as hi from cells) select attribute, level, op, metric, k, n, {_r('est')} as est, {_r('lo')} as ci_lo, {_r('hi')} as ci_hi, case when n < 10 then 'very_low_precision' when n < 30 or least(k, n - k) < 5 then 'low_precision' when (hi - lo) / 2 > 0.10 then 'wide_interval' end as flag, case when n = 0 then 'zero_denominator' end as reason from w")
def subgroup_proportions(spark, sf_dir):
    return rounded(counts.with_wilson(_cells(spark, sf_dir)))


def _family_sql() -> str:
    pos, neg, out = "(tp + fn)", "(fp + tn)", []
    add = lambda m, e, lo, hi: out.append(f"select attribute, level, op, '{m}' as metric, {_r(e)} as est, {_r(lo)} as ci_lo, {_r(hi)} as ci_hi from counts")
    for m, k, n in (("sensitivity", "tp", pos), ("specificity", "tn", neg), ("ppv", "tp", "tp + fp"), ("npv", "tn", "tn + fn"), ("accuracy", "tp + tn", f"{pos} + {neg}"), ("prevalence", pos, f"{pos} + {neg}")):
        lo, hi = _wilson(k, n)
        add(m, _div(k, n), f"case when {n} > 0 then {lo} end", f"case when {n} > 0 then {hi} end")
    lo, hi = _newcombe("tp", pos, "fp", neg)
    youden = f"({_div('tp', pos)} - {_div('fp', neg)})"
    add("youden", youden, lo, hi)
    add("balanced_accuracy", f"({youden} + 1) / 2", f"(({lo}) + 1) / 2", f"(({hi}) + 1) / 2")
    se, sp = _div("tp", pos), _div("tn", neg)
    for m, e, v, ok in (
        ("lr_pos", f"{se} / nullif(1 - {sp}, 0)", f"{_div(f'1 - {se}', 'tp')} + {_div(sp, 'fp')}", "tp > 0 and fp > 0"),
        ("lr_neg", f"(1 - {se}) / nullif({sp}, 0)", f"{_div(se, 'fn')} + {_div(f'1 - {sp}', 'tn')}", "fn > 0 and tn > 0"),
        ("dor", _div("tp::double * tn", "fp::double * fn"), " + ".join(_div("1", x) for x in ("tp", "fn", "fp", "tn")), "tp > 0 and fn > 0 and fp > 0 and tn > 0"),
    ):
        ok = f"{ok} and {pos} > 0 and {neg} > 0"
        add(m, f"case when {ok} then {e} end", f"case when {ok} then ({e}) * exp(-{Z!r} * sqrt({v})) end", f"case when {ok} then ({e}) * exp({Z!r} * sqrt({v})) end")
    add("f1", _div("2 * tp", "2 * tp + fp + fn"), "null", "null")
    add("mcc", _div("tp::double * tn - fp::double * fn", f"sqrt((tp + fp)::double * {pos} * {neg} * (tn + fn))"), "null", "null")
    return f"with {COUNTS_SQL} " + " union all ".join(out)


@query(_family_sql())
def metric_family(spark, sf_dir):
    return rounded(counts.metric_family(_counts(spark, sf_dir)))


_REFERENCE_SQL = ", refs as (select attribute, level as reference from (select attribute, level, row_number() over (partition by attribute order by count(*) desc, level) as rn from long where attribute <> 'overall' and level <> 'Unknown/missing' group by attribute, level) where rn = 1)"
_DIFF_SQL = (
    CELLS_SQL
    + _REFERENCE_SQL
    + """, sided as (select c.attribute, c.op, c.metric, c.level, 'reference' as against, c.k, c.n, r.k as k2, r.n as n2 from cells c join refs using (attribute) join cells r on r.attribute = c.attribute and r.op = c.op and r.metric = c.metric and r.level = reference where c.level <> reference
 union all select attribute, op, metric, level, 'complement', k, n, sum(k) over w - k, sum(n) over w - n from cells where attribute <> 'overall' window w as (partition by attribute, op, metric)),
 diffs as (select attribute, op, metric, level, against, least(n, n2)::bigint as n, """
    + f"{_div('k', 'n')} - {_div('k2', 'n2')} as est, {_newcombe('k', 'n', 'k2', 'n2')[0]} as lo, {_newcombe('k', 'n', 'k2', 'n2')[1]} as hi, case when n = 0 or n2 = 0 then 'zero_denominator' end as reason from sided)"
)


def _differences(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return counts.differences(counts.with_reference(cells, F.when((F.col("metric") == "accuracy") & (F.col("op") == POINTS[0].id), F.col("n"))))


@query(f"with {LONG_SQL} {_REFERENCE_SQL} select * from refs")
def reference_levels(spark, sf_dir):
    return counts.reference_levels(counts.table_one(analysed(spark, sf_dir), ATTRIBUTES))


@query(f"with {_DIFF_SQL} select attribute, op, metric, level, against, n, {_r('est')} as est, {_r('lo')} as ci_lo, {_r('hi')} as ci_hi, reason from diffs")
def proportion_differences(spark, sf_dir):
    return rounded(_differences(spark, sf_dir))


@query(
    f"with {_DIFF_SQL} select level, op, case metric when 'sensitivity' then 'tpr_gap' when 'specificity' then 'fpr_gap' when 'ppv' then 'ppv_gap' when 'npv' then 'npv_gap' else 'selection_rate_gap' end as gap, "
    f"{_r('case metric when $$specificity$$ then -est else est end')} as est, {_r('case metric when $$specificity$$ then -hi else lo end')} as ci_lo, {_r('case metric when $$specificity$$ then -lo else hi end')} as ci_hi "
    "from diffs where attribute = 'segment' and against = 'reference' and metric <> 'accuracy'"
)
def fairness_gaps(spark, sf_dir):
    d = _differences(spark, sf_dir).where("attribute = 'segment' and against = 'reference'")
    fpr = counts.mirrored(d.where("metric = 'specificity'")).withColumn("gap", F.lit("fpr_gap"))
    names = {"sensitivity": "tpr_gap", "ppv": "ppv_gap", "npv": "npv_gap", "selection_rate": "selection_rate_gap"}
    rest = d.where(F.col("metric").isin(*names)).withColumn("gap", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("metric")])
    return rounded(rest.unionByName(fpr).select("level", "op", "gap", "est", "ci_lo", "ci_hi"))


@query(
    f"with {CELLS_SQL}, e as (select *, n * (sum(k) over w)::double / sum(n) over w as e1, n * (1 - (sum(k) over w)::double / sum(n) over w) as e0 from cells where attribute <> 'overall' and level <> 'Unknown/missing' and metric in ('sensitivity', 'specificity') and n > 0 window w as (partition by attribute, op, metric)) "
    f"select attribute, op, metric, count(*) as levels, {_r('sum(pow(k - e1, 2) / nullif(e1, 0) + pow(k - e1, 2) / nullif(e0, 0))')} as chi2, {_r('min(least(e0, e1))')} as min_expected, case when count(*) < 2 then 'insufficient_levels' when min(least(e0, e1)) = 0 then 'boundary_estimate' end as reason from e group by all"
)
def homogeneity_statistics(spark, sf_dir):
    return rounded(counts.homogeneity(_cells(spark, sf_dir)).drop("cells"))


@query()
def homogeneity_tests(spark, sf_dir):
    """Chi-square or Fisher p values, then Holm within each attribute; refused tests keep their row and reason."""

    @F.pandas_udf("double")
    def p_value(chi2: pd.Series, levels: pd.Series, least: pd.Series, cells: pd.Series) -> pd.Series:
        def one(x, n, low, found):
            if pd.isna(x) or n < 2 or low == 0:
                return None
            if n == 2 and low < 5:
                (a, m), (b, k) = ((int(c["k"]), int(c["n"])) for c in found)
                return fisher_exact(a, m - a, b, k - b)
            return chi2_sf(float(x), int(n) - 1)

        return pd.Series([one(*r) for r in zip(chi2, levels, least, cells, strict=True)], dtype=float)

    tests = counts.homogeneity(_cells(spark, sf_dir)).withColumn("p", p_value("chi2", "levels", "min_expected", "cells")).drop("cells")
    refused = tests.where("p is null").withColumn("p_holm", F.lit(None).cast("double"))
    return rounded(ranks.holm(tests.where("p is not null"), ["attribute"]).unionByName(refused))


@query(
    f"with {CELLS_SQL}, t as (select attribute, op || metric as name, (1.0 * k + 1) / (n + 2) as p from cells where level <> 'all' and n > 0 and attribute = 'segment'), s as (select *, least(1.0, p * (count(*) over (partition by attribute) - row_number() over (partition by attribute order by p, name) + 1)) as x, row_number() over (partition by attribute order by p, name) as rn from t) "
    f"select attribute, name, {_r('p')} as p, {_r('max(x) over (partition by attribute order by rn)')} as p_holm from s"
)
def holm_adjusted(spark, sf_dir):
    t = _cells(spark, sf_dir).where("attribute = 'segment' and n > 0").select("attribute", F.concat("op", "metric").alias("name"), ((F.col("k") + 1) / (F.col("n") + 2)).alias("p"))
    return rounded(ranks.holm(t, ["attribute"]))


@query(
    f"with {COUNTS_SQL}, p as (select c.*, prev, tp::double / nullif(tp + fn, 0) as se, tn::double / nullif(tn + fp, 0) as sp, tp + fn as pos, tn + fp as neg from counts c, (values (0.05), (0.2), (0.5)) v(prev) where attribute = 'overall'), "
    "q as (select op, prev, se * prev / (se * prev + (1 - sp) * (1 - prev)) as ppv, sp * (1 - prev) / (sp * (1 - prev) + (1 - se) * prev) as npv, sqrt((1 - se) / (se * pos) + sp / ((1 - sp) * neg)) as es, sqrt((1 - sp) / (sp * neg) + se / ((1 - se) * pos)) as en from p) "
    f"select op, prev::double as prevalence, {_r('ppv')} as ppv, {_r(f'1 / (1 + exp(-(ln(ppv / (1 - ppv)) - {Z!r} * es)))')} as ppv_lo, {_r(f'1 / (1 + exp(-(ln(ppv / (1 - ppv)) + {Z!r} * es)))')} as ppv_hi, {_r('npv')} as npv, {_r(f'1 / (1 + exp(-(ln(npv / (1 - npv)) - {Z!r} * en)))')} as npv_lo, {_r(f'1 / (1 + exp(-(ln(npv / (1 - npv)) + {Z!r} * en)))')} as npv_hi from q"
)
def predictive_values_at_prevalence(spark, sf_dir):
    c = _counts(spark, sf_dir).where("attribute = 'overall'").withColumn("prevalence", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.2, 0.5)])))
    found = ci.predictive_at_prevalence(F.col("tp"), F.col("tp") + F.col("fn"), F.col("tn"), F.col("tn") + F.col("fp"), F.col("prevalence"))
    columns = []
    for name, (est, (lo, hi)) in found.items():
        columns += [est.alias(name), lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi")]
    return rounded(c.select("op", "prevalence", *columns))


@query(
    f"with {SHIPMENTS_SQL}, i as (select count(*) filter (prior >= 0.5) as ip, count(*) filter (prior < 0.5) as ineg from shipments where flow_state = 'indeterminate'), c as (select count(*) filter (y = 1 and score >= 0.5) as tp, count(*) filter (y = 1) as pos, count(*) filter (y = 0 and not score >= 0.5) as tn, count(*) filter (y = 0) as neg from analysed) "
    "select 'as_positive' as treated, (tp + ip)::bigint as k_se, (pos + ip)::bigint as n_se, tn::bigint as k_sp, (neg + ineg)::bigint as n_sp from c, i union all select 'as_negative', tp, pos + ip, tn + ineg, neg + ineg from c, i"
)
def indeterminates_both_ways(spark, sf_dir):
    s = shipments(spark, sf_dir)
    a, i = F.col("flow_state") == "analysed", F.col("flow_state") == "indeterminate"
    y, p = F.col("y") == 1, F.col("score") >= 0.5
    one = s.agg(F.count_if(a & y & p).alias("tp"), F.count_if(a & y).alias("pos"), F.count_if(a & ~y & ~p).alias("tn"), F.count_if(a & ~y).alias("neg"), F.count_if(i & (F.col("prior") >= 0.5)).alias("ip"), F.count_if(i & (F.col("prior") < 0.5)).alias("ineg"))
    row = lambda name, k_se, k_sp: F.struct(F.lit(name).alias("treated"), F.expr(k_se).alias("k_se"), F.expr("pos + ip").alias("n_se"), F.expr(k_sp).alias("k_sp"), F.expr("neg + ineg").alias("n_sp"))
    return one.select(F.explode(F.array(row("as_positive", "tp + ip", "tn"), row("as_negative", "tp", "tn + ineg"))).alias("x")).select("x.*")


@query(f"with {CELLS_SQL} select attribute, level, op, metric, {_r(f'case when n > 0 then n / (n + {Z * Z!r}) end')} as most, case when n > 0 then n / (n + {Z * Z!r}) >= 0.995 end as attainable from cells")
def attainability(spark, sf_dir):
    most, meets = ci.attainable(F.col("n"), ">=", 0.995)
    return rounded(_cells(spark, sf_dir).select("attribute", "level", "op", "metric", most.alias("most"), meets.alias("attainable")))


@query()
def exact_intervals(spark, sf_dir):
    """Clopper-Pearson companions of the overall proportions."""

    @F.pandas_udf("lo double, hi double")
    def exact(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b)) or (None, None) for a, b in zip(k, n, strict=True)], columns=["lo", "hi"], dtype=float)

    return rounded(_cells(spark, sf_dir).where("attribute = 'overall'").withColumn("x", exact("k", "n")).select("op", "metric", "k", "n", F.col("x.lo").alias("ci_lo"), F.col("x.hi").alias("ci_hi")))


# --- ranks --------------------------------------------------------------------------------------------

_HIST = LONG_SQL + ", hist as (select attribute, level, score as s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from long group by all), "
_PLACED = """v as (select *, sum(p) over a as np, sum(q) over a as nq, coalesce(sum(q) over b, 0) as ql, coalesce(sum(p) over b, 0) as pl from hist window a as (partition by attribute, level), b as (partition by attribute, level order by s rows between unbounded preceding and 1 preceding)),
u as (select *, (ql + q / 2.0)::double / nullif(nq, 0) as v10, 1 - (pl + p / 2.0)::double / nullif(np, 0) as v01 from v),
areas as (select attribute, level, max(np)::bigint as n_pos, max(nq)::bigint as n_neg, sum(p * v10) / nullif(max(np), 0) as auc,
 sqrt(greatest(0, sum(p * v10 * v10) - pow(sum(p * v10), 2) / nullif(max(np), 0)) / nullif(max(np) - 1, 0) / nullif(max(np), 0) + greatest(0, sum(q * v01 * v01) - pow(sum(q * v01), 2) / nullif(max(nq), 0)) / nullif(max(nq) - 1, 0) / nullif(max(nq), 0)) as se from u group by attribute, level)"""


def _long(spark, sf_dir):
    a = analysed(spark, sf_dir)
    h = a.groupBy(*ATTRIBUTES, "score", "y").agg(F.count("*").alias("c"))
    return counts.unfold(h, ATTRIBUTES, ["score", "y", "c"]).groupBy("attribute", "level", "score", "y").agg(F.sum("c").alias("c"))


def _areas(spark, sf_dir):
    """auroc() of every level from one histogram of the whole cohort."""
    at = ["attribute", "level"]
    h = _long(spark, sf_dir).groupBy(*at, F.col("score").alias("s")).agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("q"))
    return ranks.areas(h, at)


@query(f"with {_HIST} {_PLACED} select attribute, level, n_pos, n_neg, {_r('auc')} as auc, {_r('se')} as se from areas")
def auroc_by_level(spark, sf_dir):
    return rounded(_areas(spark, sf_dir))


@query(
    f"with {_HIST} {_PLACED}, m as (select *, least(n_pos, n_neg) as sm, case when least(n_pos, n_neg) = 0 then 'single_class' when n_pos < 2 then 'insufficient_positives' when n_neg < 2 then 'insufficient_negatives' when auc <= 0 or auc >= 1 or se = 0 then 'boundary_estimate' end as reason from areas), k as (select *, case when reason is null then case when auc > 0.9 or sm < 30 then 'delong_logit' else 'delong_wald' end end as method from m), "
    f"b as (select *, ln(auc / nullif(1 - auc, 0)) as eta, se / nullif(auc * (1 - auc), 0) as el from k) select attribute, level, n_pos, n_neg, {_r('auc')} as auc, {_r('se')} as se, reason, method, {_r(f'case method when $$delong_logit$$ then 1 / (1 + exp(-(eta - {Z!r} * el))) when $$delong_wald$$ then least(greatest(auc - {Z!r} * se, 0), 1) end')} as ci_lo, {_r(f'case method when $$delong_logit$$ then 1 / (1 + exp(-(eta + {Z!r} * el))) when $$delong_wald$$ then least(greatest(auc + {Z!r} * se, 0), 1) end')} as ci_hi, case when sm < 10 then 'very_low_precision' end as flag from b"
)
def auroc_intervals(spark, sf_dir):
    return rounded(ranks.auroc_interval(_areas(spark, sf_dir)))


@query(
    f"with {_HIST} {_PLACED} {_REFERENCE_SQL}, d as (select a.attribute, a.level, least(a.n_pos, b.n_pos) as mp, least(a.n_neg, b.n_neg) as mn, a.auc - b.auc as est, sqrt(a.se * a.se + b.se * b.se) as sd, a.se = 0 or b.se = 0 as flat from areas a join refs using (attribute) join areas b on b.attribute = a.attribute and b.level = reference and a.level <> reference), r as (select *, case when mp < 10 then 'insufficient_positives' when mn < 10 then 'insufficient_negatives' when flat then 'boundary_estimate' end as reason from d) "
    f"select attribute, level, {_r('case when mp >= 10 and mn >= 10 then est end')} as est, {_r(f'case when reason is null then est - {Z!r} * sd end')} as ci_lo, {_r(f'case when reason is null then est + {Z!r} * sd end')} as ci_hi, reason from r"
)
def auroc_differences(spark, sf_dir):
    a = counts.with_reference(_areas(spark, sf_dir), F.col("n_pos") + F.col("n_neg"))
    own = F.struct("auc", "se", "n_pos", "n_neg")
    a = a.withColumn("base", F.max(F.when(F.col("level") == F.col("reference"), own)).over(Window.partitionBy("attribute")))
    a = a.where("level <> reference").withColumns({f"{c}_b": F.col("base")[c] for c in ("auc", "se", "n_pos", "n_neg")})
    out = compare.area_differences(a)
    return rounded(out.select("attribute", "level", "est", "ci_lo", "ci_hi", "reason"))


@query(f"with {SHIPMENTS_SQL}, h as (select score as threshold, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from analysed group by 1) select 'all' as cohort, {_r('threshold')} as threshold, (sum(p) over w)::bigint as tp, (sum(q) over w)::bigint as fp, {_r('sum(p) over w / sum(p) over ()')} as tpr, {_r('sum(q) over w / sum(q) over ()')} as fpr from h window w as (order by threshold desc) union all select 'all', null, 0, 0, 0, 0 where exists (select 1 from h)")
def roc_curve(spark, sf_dir):
    return rounded(ranks.roc_curve(analysed(spark, sf_dir).withColumn("cohort", F.lit("all")), ["cohort"]))


@query(f"with {COUNTS_SQL} select op, {_r(_div('tp', 'tp + fn'))} as tpr, {_r(_div('fp', 'fp + tn'))} as fpr from counts where attribute = 'overall'")
def operating_points_on_roc(spark, sf_dir):
    c = _counts(spark, sf_dir).where("attribute = 'overall'")
    return rounded(c.select("op", ci.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), ci.ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr")))


@query(f"with {SHIPMENTS_SQL}, r as (select score as s, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as midrank from analysed) select {_r('s')} as s, count(*) as n, {_r('min(midrank)')} as midrank from r group by s")
def midranks(spark, sf_dir):
    return rounded(ranks.midranks(analysed(spark, sf_dir), "score"))


# --- calibration --------------------------------------------------------------------------------------

_CAL = f"""m as (select count(*) as n, sum(y)::bigint as events, sum(score) as expected, avg(pow(score - y, 2)) as brier from analysed), c as (select *, events / n::double as rate, sqrt((1 - events / n::double) / events) as se from m)"""


@query(f"with {SHIPMENTS_SQL}, {_CAL} select 'all' as cohort, n, events, {_r('expected')} as expected, {_r('brier')} as brier, {_r('rate * (1 - rate)')} as brier_ref, {_r('events / expected')} as oe, {_r(f'events / expected * exp(-{Z!r} * se)')} as oe_lo, {_r(f'events / expected * exp({Z!r} * se)')} as oe_hi, null::varchar as reason, {_r('1 - brier / (rate * (1 - rate))')} as ipa from c")
def calibration_summary(spark, sf_dir):
    return rounded(calibration.summary(analysed(spark, sf_dir).withColumn("cohort", F.lit("all")), ["cohort"]))


_BINS = ", ".join(f"(case when score > {i / 10!r} then 1 else 0 end)" for i in range(1, 10)).replace(", ", " + ")
_BIN_SQL = f"with {VISITS_SQL}, b as (select *, ({_BINS})::bigint as bin from visits), t as (select bin, count(*) as n, sum(y)::bigint as events, avg(score) as mean_pred, min(score) as score_min, max(score) as score_max from b group by bin) "
_BLO, _BHI = _wilson("events", "n")
_BIN_COLUMNS = f"select bin, n, events, {_r('mean_pred')} as mean_pred, {_r('score_min')} as score_min, {_r('score_max')} as score_max, {_r('events / n::double')} as observed, {_r(_BLO)} as ci_lo, {_r(_BHI)} as ci_hi from t"
_MASS_SQL = f"with {VISITS_SQL}, b as (select *, ntile(10) over (order by score, event_id) - 1 as bin from visits), t as (select bin, count(*) as n, sum(y)::bigint as events, avg(score) as mean_pred, min(score) as score_min, max(score) as score_max from b group by bin) "
_ECE = f"select sum(n)::bigint as n, {_r('sum(n * abs(events / n::double - mean_pred)) / sum(n)')} as ece from t"


def _equal_width(spark, sf_dir):
    v = visits(spark, sf_dir)
    return calibration.binned(v.withColumn("bin", calibration.equal_width_bin(F.col("score")).cast("long")), "score")


def _equal_mass(spark, sf_dir):
    return calibration.binned(calibration.mass_bins(visits(spark, sf_dir), "score", "event_id"), "score")


@query(_BIN_SQL + _BIN_COLUMNS)
def calibration_bins(spark, sf_dir):
    return rounded(_equal_width(spark, sf_dir))


@query(_MASS_SQL + f", c as ({_BIN_COLUMNS}) select b.bin::bigint as bin, coalesce(n, 0) as n, coalesce(events, 0) as events, mean_pred, score_min, score_max, observed, ci_lo, ci_hi, case when n is null then 'zero_denominator' end as reason from range(10) b(bin) left join c on c.bin = b.bin")
def decile_curve(spark, sf_dir):
    return rounded(calibration.curve(_equal_mass(spark, sf_dir)))


@query(_BIN_SQL + _ECE)
def ece_equal_width(spark, sf_dir):
    return rounded(calibration.calibration_error(_equal_width(spark, sf_dir)))


@query(_MASS_SQL + _ECE)
def ece_equal_mass(spark, sf_dir):
    return rounded(calibration.calibration_error(_equal_mass(spark, sf_dir)))


def _newton_sql(name: str, slope: bool) -> str:
    """A recursive table of fourteen Newton steps, and the last one's estimates with standard errors."""
    eta = "(a + b * x)"
    mu = f"(case when {eta} >= 0 then 1 / (1 + exp(-{eta})) else exp({eta}) / (1 + exp({eta})) end)"
    sums = f"sum(c * {mu} * (1 - {mu})) as w0, sum(c * {mu} * (1 - {mu}) * x) as w1, sum(c * {mu} * (1 - {mu}) * x * x) as w2, sum(c * (y - {mu})) as r0, sum(c * (y - {mu}) * x) as r1"
    da, db = ("(w2 * r0 - w1 * r1) / (w0 * w2 - w1 * w1)", "(w0 * r1 - w1 * r0) / (w0 * w2 - w1 * w1)") if slope else ("r0 / w0", "0.0")
    return (
        f"{name} as (select 0 as k, 0.0::double as a, {'0.0' if slope else '1.0'}::double as b, null::double as w0, null::double as w1, null::double as w2 union all "
        f"select k + 1, a + {da}, b + {db}, w0, w1, w2 from (select k, a, b, {sums} from (select k, a, b from {name}) t, cells group by k, a, b) s where k < 14)"
    )


@query(
    f"with recursive {VISITS_SQL}, cells as (select ln(c0 / (1 - c0)) as x, y::double as y, count(*)::double as c from (select greatest(1e-12, least(score, 1 - 1e-12)) as c0, y from visits) group by 1, 2), {_newton_sql('large', False)}, {_newton_sql('line', True)}, "
    "f as (select 'intercept_large' as parameter, a as est, sqrt(1 / w0) as se from large where k = 14 union all select 'intercept', a, sqrt(w2 / (w0 * w2 - w1 * w1)) from line where k = 14 union all select 'slope', b, sqrt(w0 / (w0 * w2 - w1 * w1)) from line where k = 14) "
    f"select parameter, {_r('est')} as est, {_r('se')} as se, {_r(f'est - {Z!r} * se')} as ci_lo, {_r(f'est + {Z!r} * se')} as ci_hi, null::varchar as reason from f"
)
def recalibration(spark, sf_dir):
    return rounded(calibration.recalibration(visits(spark, sf_dir)))


@query(f"with {VISITS_SQL} select event_id, {_r('ln(c / (1 - c))')} as logit, {_r('c')} as back, c <> score as clipped from (select *, greatest(1e-12, least(score, 1 - 1e-12)) as c from visits)")
def logit_scores(spark, sf_dir):
    v = visits(spark, sf_dir).withColumn("logit", ci.logit(F.col("score")))
    return rounded(v.select("event_id", "logit", ci.expit(F.col("logit")).alias("back"), (F.greatest(F.lit(1e-12), F.least("score", F.lit(1 - 1e-12))) != F.col("score")).alias("clipped")))


# --- versions -----------------------------------------------------------------------------------------


def _versions(spark, sf_dir):
    v = visits(spark, sf_dir)
    return v.where("prior is not null").withColumn("cohort", F.lit("all"))


@query(f"with {VISITS_SQL}, a as (select event_id as k, y from visits where score > 0.001), b as (select event_id as k, y from visits where prior is not null and prior < 0.98) select count(*) filter (a.k is not null and b.k is not null and a.y = b.y) as pairs, count(*) filter (a.k is not null and b.k is not null and a.y <> b.y) as label_mismatch, count(*) filter (b.k is null) as new_only, count(*) filter (a.k is null) as prior_only, count(*) filter (b.k is null or a.k is null or a.y <> b.y) = 0 as paired from a full join b on a.k = b.k")
def paired_join(spark, sf_dir):
    v = visits(spark, sf_dir)
    return compare.join_counts(v.where("score > 0.001"), v.where("prior < 0.98"), "event_id")


def _paired_sql() -> str:
    parts = []
    for op, rule in (("op1", ">= 0.5"), ("op2", "> 0.7")):
        a, b = f"(score {rule})", f"(prior {rule})"
        for m, w, x, y in (("sensitivity", "y = 1", a, b), ("specificity", "y = 0", f"not {a}", f"not {b}"), ("accuracy", "true", f"{a} = (y = 1)", f"{b} = (y = 1)")):
            parts.append(f"select 'all' as cohort, '{op}' as op, '{m}' as metric, count(*) filter ({w} and ({x}) and ({y})) as e, count(*) filter ({w} and ({x}) and not ({y})) as f, count(*) filter ({w} and not ({x}) and ({y})) as g, count(*) filter ({w} and not ({x}) and not ({y})) as h from visits where prior is not null")
    return f"with {VISITS_SQL}, pc as ({' union all '.join(parts)})"


_PAIRED = _paired_sql()


def _paired_diff_sql() -> str:
    (l1, u1), (l2, u2) = _wilson("(e + f)", "n"), _wilson("(e + g)", "n")
    return f"""{_PAIRED}, a as (select *, e + f + g + h as n from pc),
b as (select *, (e + f)::double / n as p1, (e + g)::double / n as p2, {l1} as l1, {u1} as u1, {l2} as l2, {u2} as u2, (e * h - f * g)::double as cr, (e + f)::double * (g + h) * (e + g) * (f + h) as pr from a),
c as (select *, case when pr = 0 then 0 else (case when cr > 0 then greatest(cr - n / 2.0, 0) else cr end) / sqrt(pr) end as phi from b)
select cohort, op, metric, e, f, g, h, n, {_r('(f - g)::double / n')} as est,
{_r('least(greatest(p1 - p2 - sqrt(greatest(0, pow(p1 - l1, 2) - 2 * phi * (p1 - l1) * (u2 - p2) + pow(u2 - p2, 2))), -1), 1)')} as ci_lo,
{_r('least(greatest(p1 - p2 + sqrt(greatest(0, pow(u1 - p1, 2) - 2 * phi * (u1 - p1) * (p2 - l2) + pow(p2 - l2, 2))), -1), 1)')} as ci_hi from c"""


@query(_paired_diff_sql())
def paired_differences(spark, sf_dir):
    return rounded(compare.paired_differences(compare.paired_cells(_versions(spark, sf_dir), POINTS, ["cohort"])))


@query(f"{_PAIRED} select op, metric, f, g, {_r('case when f + g >= 25 then pow(greatest(0, abs(f - g) - 1), 2) / (f + g) end')} as statistic, case when f + g >= 25 then 'chi2_continuity' else 'exact' end as method from pc")
def mcnemar_statistics(spark, sf_dir):
    cells = compare.paired_cells(_versions(spark, sf_dir), POINTS, ["cohort"])
    return rounded(compare.mcnemar(cells).select("op", "metric", "f", "g", "statistic", "method"))


@query()
def mcnemar_tests(spark, sf_dir):
    cells = compare.paired_cells(_versions(spark, sf_dir), POINTS, ["cohort"])
    return rounded(compare.mcnemar(cells).select("op", "metric", "f", "g", "method", "statistic", "p"))


def _delong_sql() -> str:
    side = lambda c, i: f"h{i} as (select {c} as s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from vv group by 1), w{i} as (select s, (coalesce(sum(q) over o, 0) + q / 2.0) / sum(q) over () as v10, 1 - (coalesce(sum(p) over o, 0) + p / 2.0) / sum(p) over () as v01 from h{i} window o as (order by s rows between unbounded preceding and 1 preceding))"
    return f"""with {VISITS_SQL}, vv as (select * from visits where prior is not null), {side('score', 1)}, {side('prior', 2)},
j as (select y, a.v10 as a10, b.v10 as b10, a.v01 as a01, b.v01 as b01 from vv join w1 a on vv.score = a.s join w2 b on vv.prior = b.s),
m as (select count(*) filter (y = 1) as np, count(*) filter (y = 0) as nq, avg(a10) filter (y = 1) as auc_new, avg(b10) filter (y = 1) as auc_prior, var_samp(a10 - b10) filter (y = 1) / count(*) filter (y = 1) + var_samp(a01 - b01) filter (y = 0) / count(*) filter (y = 0) as v from j)
select 'all' as cohort, np as n_pos, nq as n_neg, {_r('auc_new')} as auc_new, {_r('auc_prior')} as auc_prior, {_r('auc_new - auc_prior')} as est, {_r('sqrt(v)')} as se, {_r(f'auc_new - auc_prior - {Z!r} * sqrt(v)')} as ci_lo, {_r(f'auc_new - auc_prior + {Z!r} * sqrt(v)')} as ci_hi, {_r('(auc_new - auc_prior) / sqrt(v)')} as z from m"""


@query(_delong_sql())
def paired_delong(spark, sf_dir):
    return rounded(ranks.paired_delong(_versions(spark, sf_dir), ["cohort"]))


@query()
def paired_delong_p(spark, sf_dir):
    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return z.map(two_sided_p, na_action="ignore")

    return rounded(ranks.paired_delong(_versions(spark, sf_dir), ["cohort"]).select("est", "z", p("z").alias("p")))


def _halves(spark, sf_dir):
    v = visits(spark, sf_dir)
    new, prior = v.where("event_id % 2 = 0"), v.where("event_id % 2 = 1 and prior is not null").withColumn("score", F.col("prior"))
    return [counts.proportions(counts.two_by_two(d.where("score is not null"), ["event_type"], POINTS)).where(F.col("attribute") == counts.OVERALL[0]) for d in (new, prior)]


_NC_LO, _NC_HI = _newcombe("k", "n", "k2", "n2")


@query(
    f"with {VISITS_SQL}, v as (select event_id % 2 as side, y, case event_id % 2 when 0 then score else prior end as score from visits), p as (select side, y, 'op1' as op, score >= 0.5 as p from v where score is not null union all select side, y, 'op2', score > 0.7 from v where score is not null), "
    "t as (select side, op, count(*) filter (y = 1 and p) as tp, count(*) filter (y = 1 and not p) as fn, count(*) filter (y = 0 and p) as fp, count(*) filter (y = 0 and not p) as tn from p group by all), c as ("
    + " union all ".join(f"select side, op, '{m}' as metric, {k} as k, {n} as n from t" for m, k, n in (("sensitivity", "tp", "tp + fn"), ("specificity", "tn", "tn + fp"), ("ppv", "tp", "tp + fp"), ("npv", "tn", "tn + fn"), ("accuracy", "tp + tn", "tp + fn + fp + tn"), ("selection_rate", "tp + fp", "tp + fn + fp + tn")))
    + "), j as (select a.op, a.metric, a.k, a.n, b.k as k2, b.n as n2 from c a join c b on a.op = b.op and a.metric = b.metric and a.side = 0 and b.side = 1) "
    f"select op, metric, n, n2, {_r(_div('k', 'n') + ' - ' + _div('k2', 'n2'))} as est, {_r(_NC_LO)} as ci_lo, {_r(_NC_HI)} as ci_hi, 'not_like_for_like' as flag, case when n = 0 or n2 = 0 then 'zero_denominator' end as reason from j"
)
def unpaired_version_differences(spark, sf_dir):
    return rounded(compare.unpaired_differences(*_halves(spark, sf_dir), ["op", "metric"]))


@query(f"with {VISITS_SQL}, a as (select distinct event_id from visits where score > 0.001), b as (select distinct event_id from visits where prior < 0.98) select 'W12' as code, count(*) filter (a.event_id is null or b.event_id is null) as unmatched, false as halts from a full join b on a.event_id = b.event_id")
def pairing_gate(spark, sf_dir):
    v = visits(spark, sf_dir)
    return gates.pairing(v.where("score > 0.001"), v.where("prior < 0.98"), "event_id", allow_unpaired=True)


# --- clusters and resampling --------------------------------------------------------------------------


def _hits(spark, sf_dir):
    y, p = F.col("y") == 1, POINTS[0].positive(F.col("score"))
    return analysed(spark, sf_dir).select("case_id", "segment", F.when(y, "sensitivity").otherwise("specificity").alias("metric"), (y == p).cast("int").alias("hit"))


_DEFF_LO, _DEFF_HI = _wilson("(est * ne)", "ne")


@query(
    f"with {SHIPMENTS_SQL}, hits as (select case_id, segment, case y when 1 then 'sensitivity' else 'specificity' end as metric, ((score >= 0.5) = (y = 1))::int as hit from analysed), units as (select metric, segment, case_id, count(*) as m, sum(hit) as u from hits group by all), "
    "s as (select metric, segment, count(*) as cases, sum(m)::bigint as n, sum(u)::bigint as k, max(m) as largest, sum(u * u)::double as uu, sum(u * m)::double as um, sum(m * m)::double as mm from units group by all), "
    "d as (select *, k / n::double as est, case when largest = 1 then 1.0 when cases >= 2 then case when k in (0, n) then mm / n else greatest(1, cases / (cases - 1.0) * (uu - 2 * (k / n::double) * um + pow(k / n::double, 2) * mm) / (n::double * n) / (k / n::double * (1 - k / n::double) / n)) end end as deff, case when cases < 2 then 'not_estimable' when cases < 5 then 'below_coverage_bar' when largest > 0.2 * n then 'case_share_above_grid' when n > 50 * cases then 'rows_per_case_above_grid' else 'wilson_deff' end as route from s), e as (select *, n / deff as ne from d) "
    f"select metric, segment, cases, n, k, largest, {_r('deff')} as deff, route, {_r('est')} as est, {_r(f'case route when $$wilson_deff$$ then {_DEFF_LO} end')} as ci_lo, {_r(f'case route when $$wilson_deff$$ then {_DEFF_HI} end')} as ci_hi from e"
)
def design_effects(spark, sf_dir):
    return rounded(counts.design_effect(_hits(spark, sf_dir), "case_id", ["metric", "segment"]))


@query(f"with {SHIPMENTS_SQL} select count(*) as n_rows, count(distinct case_id) as n_units, case when count(distinct case_id) < count(*) then 'detected' else 'none' end as route from analysed")
def cluster_plan(spark, sf_dir):
    a = analysed(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_distinct("case_id").alias("n_units"))
    return a.withColumn("route", F.when(F.col("n_units") < F.col("n_rows"), "detected").otherwise("none"))


@query(f"with {SHIPMENTS_SQL}, c as (select case_id, count(distinct coalesce(status, 'Unknown/missing')) as n from analysed group by 1) select count(*) as cases, count(*) filter (n > 1) as spanning from c")
def case_overlap(spark, sf_dir):
    a = analysed(spark, sf_dir).withColumn("status", F.coalesce("status", F.lit(counts.UNKNOWN)))
    return gates.shared_cases(a, "case_id", "status")


@query(f"with {VISITS_SQL}, f as (select *, first_value(y) over (partition by case_id order by event_id) as y0 from visits) select count(*) filter (y <> y0) as n_conflicting from f")
def conflicting_case_labels(spark, sf_dir):
    return gates.conflicting_labels(visits(spark, sf_dir), "case_id", "event_id")


@query()
def bootstrap_auroc(spark, sf_dir):
    return rounded(resample.bootstrap_auroc(analysed(spark, sf_dir), ["segment"]))


@query()
def bootstrap_clustered_proportions(spark, sf_dir):
    return rounded(resample.bootstrap_clustered_proportion(_hits(spark, sf_dir), "case_id", ["metric", "segment"]))


@query()
def bootstrap_paired_brier(spark, sf_dir):
    return rounded(resample.bootstrap_paired_brier(_versions(spark, sf_dir), ["cohort"]))


@query()
def bootstrap_clustered_auroc(spark, sf_dir):
    return rounded(resample.bootstrap_clustered_auroc(visits(spark, sf_dir).withColumn("cohort", F.lit("all")), "case_id", ["cohort"]))


@query()
def bootstrap_brier(spark, sf_dir):
    return rounded(resample.bootstrap_brier(analysed(spark, sf_dir), ["segment"]))


@query()
def bootstrap_clustered_differences(spark, sf_dir):
    return rounded(resample.bootstrap_clustered_difference(_hits(spark, sf_dir), "case_id", "segment", ["metric"], "BUILDING"))


@query()
def bootstrap_clustered_calibration(spark, sf_dir):
    return rounded(resample.bootstrap_clustered_calibration(visits(spark, sf_dir).withColumn("cohort", F.lit("all")), "case_id", ["cohort"]))


@query()
def bootstrap_clustered_area_differences(spark, sf_dir):
    return rounded(resample.bootstrap_clustered_area_difference(analysed(spark, sf_dir).withColumn("cohort", F.lit("all")), "case_id", "segment", ["cohort"], "BUILDING"))


@query()
def bootstrap_clustered_paired(spark, sf_dir):
    return rounded(resample.bootstrap_clustered_paired(_versions(spark, sf_dir), "case_id", ["cohort"]))


@query()
def bootstrap_clustered_paired_proportions(spark, sf_dir):
    return rounded(compare.clustered_paired_differences(_versions(spark, sf_dir), POINTS, "case_id", ["cohort"]))


@query(
    f"with {SHIPMENTS_SQL}, u as (select segment, case_id, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from analysed group by all), "
    "t as (select *, case when q = 0 then 'pos' when p = 0 then 'neg' else 'mixed' end as stratum, sum(p + q) over (partition by segment) * p - sum(p) over (partition by segment) * (p + q) as balance from u), "
    "s as (select segment, stratum, count(*) as units, sum(p * p)::double as pp, sum(q * q)::double as qq, min(balance) = max(balance) as even from t group by all), "
    "r as (select segment, coalesce(sum(units) filter (stratum = 'pos'), 0)::bigint as units_pos, coalesce(sum(units) filter (stratum = 'neg'), 0)::bigint as units_neg, coalesce(sum(units) filter (stratum = 'mixed'), 0)::bigint as units_mixed, coalesce(sum(case when units = 1 then pp else 0 end) / nullif(sum(pp), 0), 0) as frozen_pos, coalesce(sum(case when units = 1 then qq else 0 end) / nullif(sum(qq), 0), 0) as frozen_neg, bool_and(even) as invariant from s group by 1), "
    "d as (select *, greatest(units_pos, units_mixed) < 2 or frozen_pos >= 0.2 as short_pos, greatest(units_neg, units_mixed) < 2 or frozen_neg >= 0.2 as short_neg from r) "
    f"select segment, units_pos, units_neg, units_mixed, {_r('frozen_pos')} as frozen_pos, {_r('frozen_neg')} as frozen_neg, invariant, case when short_pos and (not short_neg or units_pos <= units_neg) then 'positive' when short_neg then 'negative' end as deficient from d"
)
def class_strata(spark, sf_dir):
    return rounded(resample.class_strata(analysed(spark, sf_dir), "case_id", ["segment"]))


# --- gates, criteria, egress --------------------------------------------------------------------------


@query(
    f"with {SHIPMENTS_SQL}, one as (select count(*) filter (y_true not in ('R', 'N', 'A')) as h02, count(*) filter (score < 0 or score > 1) as h03, count(row_id) - count(distinct row_id) as repeated from shipments), first as (select count(*) filter (y_true <> y0) as conflicting from (select y_true, first_value(y_true) over (partition by case_id order by row_id) as y0 from shipments where case_id is not null and y_true is not null)), two as (select (min(y) = max(y))::bigint as h06, (abs(avg(y) - 0.5) > 0.10)::bigint as w10, (count(distinct case_id) < count(*))::bigint as w13 from analysed), "
    "sites as (select count(*) filter (c < 2) as w06 from (select segment, count(distinct y) as c from analysed group by 1)), r as (select score, y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as mr from analysed), "
    "h4 as (select count(*) filter ((prior >= 0.5) <> (score >= 0.5)) as h04 from analysed), area as (select ((sum(mr) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)) < 0.5)::bigint as h01 from r), g as ("
    + " union all ".join(f"select {i} as step, '{c}' as code, {v}::bigint as n, {str(c[0] == 'H').lower()} as halting from one, first, two, sites, area, h4" for i, (c, v) in enumerate((("H02", "h02"), ("H03", "h03"), ("H05", "case when repeated > 0 then repeated else conflicting end"), ("H06", "h06"), ("H01", "h01"), ("H04", "h04"), ("H08", "0"), ("W10", "w10"), ("W06", "w06"), ("W13", "w13"))))
    + ") select *, halting and n > 0 as halts from g"
)
def gate_report(spark, sf_dir):
    raw = shipments(spark, sf_dir)
    a = analysed(spark, sf_dir).withColumn("y_pred_positive", F.col("prior") >= 0.5)  # another version's prediction
    return gates.gate_report(raw, a, ("R", "N", "A"), POINTS[0], 0.5, "segment", "case_id", clustered=False, points=len(POINTS), parts=parts(table(spark, sf_dir, "lineitem")))


@query("select o_orderpriority as value, count(*) as count from orders where o_orderpriority is not null and o_orderpriority not in ('1-URGENT', '2-HIGH') group by 1")
def unknown_values(spark, sf_dir):
    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "value string")
    return gates.unknown_values(table(spark, sf_dir, "orders"), "o_orderpriority", allowed)


CRITERIA = [
    ("C1", "overall", "all", "op1", "sensitivity", "ci_lower_bound", ">=", 0.3),
    ("C2", "overall", "all", "op2", "specificity", "estimate", ">", 0.9),
    ("C3", "segment", "BUILDING", "op1", "ppv", "ci_upper_bound", "<=", 0.7),
    ("C4", "segment", "NOWHERE", "op1", "npv", "estimate", ">=", 0.1),
    ("C5", "priority", "1-URGENT", "op2", "accuracy", "ci_lower_bound", ">=", 0.999),
]
_CRITERIA_SQL = ", ".join(str(c) for c in CRITERIA)


@query(
    f"with {CELLS_SQL}, w as (select *, {_div('k', 'n')} as est, {_LO} as lo, {_HI} as hi from cells), cr as (select * from (values {_CRITERIA_SQL}) v(id, attribute, level, op, metric, statistic, comparator, value)), "
    "j as (select cr.*, w.n, w.attribute is not null as known, case statistic when 'estimate' then est when 'ci_lower_bound' then lo else hi end as stat from cr left join w using (attribute, level, op, metric)), "
    "r as (select *, case when not known then 'cell_not_found' when stat is null then 'no_interval' end as reason, case comparator when '>=' then stat >= value when '>' then stat > value when '<=' then stat <= value else stat < value end as holds, comparator in ('>=', '>') and statistic = 'ci_lower_bound' as meets from j) "
    f"select id, attribute, level, op, metric, {_r('stat')} as stat, case when reason is not null then 'not_assessable' when holds then 'met' else 'not_met' end as status, reason, {_r(f'case when meets and n > 0 then n / (n + {Z * Z!r}) end')} as most_attainable, case when meets then n / (n + {Z * Z!r}) >= value end as attainable from r"
)
def criteria_results(spark, sf_dir):
    rows = spark.createDataFrame(CRITERIA, "id string, attribute string, level string, op string, metric string, statistic string, comparator string, value double")
    return rounded(criteria.evaluate(rows, counts.with_wilson(_cells(spark, sf_dir))))


WHITELIST = {
    "attribute": {"enum": ["overall", *ATTRIBUTES]},
    "level": {"type": "string", "pattern": "[ -~]*", "maxLength": 40},
    "op": {"enum": [p.id for p in POINTS]},
    "metric": {"type": "string", "pattern": "[a-z_]+", "maxLength": 20},
    "n": {"type": ["integer", "null"]},
    "est": {"type": ["number", "null"]},
    "suppressed": {"type": "boolean"},
}
_HIDE = "(coalesce(n < 10 or k < 5 or n - k < 5, true))"


@query(f"with {CELLS_SQL}, w as (select *, {_div('k', 'n')} as e, case when n > 0 then {_LO} end as lo, case when n > 0 then {_HI} end as hi, {_HIDE} as suppressed from cells) select attribute, level, op, metric, case when not suppressed then n end as n, case when not suppressed then k end as k, {_r('case when not suppressed then e end')} as est, {_r('case when not suppressed then lo end')} as ci_lo, {_r('case when not suppressed then hi end')} as ci_hi, suppressed from w")
def suppressed_cells(spark, sf_dir):
    return rounded(criteria.project(counts.with_wilson(_cells(spark, sf_dir))))


@query(f"with {CELLS_SQL}, w as (select *, {_div('k', 'n')} as e, {_HIDE} as suppressed from cells) select attribute, level, op, metric, case when not suppressed then n end as n, {_r('case when not suppressed then e end')} as est, suppressed from w")
def whitelisted_cells(spark, sf_dir):
    return criteria.whitelisted(rounded(criteria.project(counts.with_wilson(_cells(spark, sf_dir)))), WHITELIST)


@query(f"with {LONG_SQL}, l as (select distinct attribute, level from long where attribute <> 'overall'), r as (select *, dense_rank() over (partition by attribute order by level) as rk from l) select attribute, level, case when attribute not in ('segment') and regexp_matches(level, '^[A-Za-z0-9<>=+-]{{1,3}}$') then level else upper(attribute[1]) || attribute[2:] || ' ' || chr((64 + rk)::int) end as pseudonym from r")
def pseudonyms(spark, sf_dir):
    levels = counts.table_one(analysed(spark, sf_dir), ATTRIBUTES).select("attribute", "level")
    return criteria.pseudonyms(levels, ("segment",))


@query(f"with {_DIFF_SQL} select attribute, op, metric, level, against, case when lo > 0 then 'above' when hi < 0 then 'below' when lo is not null then 'within' when est is not null then 'estimate' else 'not_assessable' end as relation from diffs")
def claim_relations(spark, sf_dir):
    d = _differences(spark, sf_dir)
    return d.select("attribute", "op", "metric", "level", "against", criteria.relation(F.col("ci_lo"), F.col("ci_hi"), F.col("est")).alias("relation"))


@query(f"with {LONG_SQL} select attribute, level, case when count(*) < 1000 then '<1k' when count(*) < 10000 then '1k-10k' when count(*) <= 100000 then '10k-100k' else '>100k' end as bucket from long group by 1, 2")
def row_buckets(spark, sf_dir):
    t = counts.table_one(analysed(spark, sf_dir), ATTRIBUTES).select("attribute", "level", "n")
    overall = analysed(spark, sf_dir).agg(F.lit("overall").alias("attribute"), F.lit("all").alias("level"), F.count("*").alias("n"))
    return t.unionByName(overall).select("attribute", "level", criteria.row_bucket(F.col("n")).alias("bucket"))


@query(f"with {VISITS_SQL} select date_trunc('day', ts) as start, count(*) filter (y = 1 and score >= 0.5) as tp, count(*) filter (y = 1 and not score >= 0.5) as fn, count(*) filter (y = 0 and score >= 0.5) as fp, count(*) filter (y = 0 and not score >= 0.5) as tn from visits group by 1")
def windowed_confusion(spark, sf_dir):
    return windowed_counts(visits(spark, sf_dir), POINTS[0])
