"""Registered queries of average precision, drift, agreement and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import agreement
from cohortlens.plans.cohorts import ATTRIBUTES, LONG_SQL, SHIPMENTS_SQL, VISITS_SQL, analysed, shipments, visits
from cohortlens.plans.queries import _long, _r, query, rounded

_COHORTS = "r as (select min(period) as base from analysed)"


def _reference(rows) -> str:
    """The earliest period."""
    return rows.agg(F.min("period")).first()[0] or ""


@query(
    f"with {LONG_SQL}, h as (select attribute, level, score, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from long group by all), c as (select *, sum(p) over w as tp, sum(q) over w as fp from h window w as (partition by attribute, level order by score desc)) "
    f"select attribute, level, sum(p)::bigint as n_pos, sum(q)::bigint as n_neg, {_r('case when sum(p) > 0 and sum(q) > 0 then sum(p * tp / (tp + fp)) / sum(p) end')} as auprc, case when sum(p) = 0 or sum(q) = 0 then 'single_class' end as reason from c group by all"
)
def average_precision(spark, sf_dir):
    at = ["attribute", "level"]
    side = lambda y: F.sum(F.when(F.col("y") == y, F.col("c")).otherwise(0))
    h = _long(spark, sf_dir).groupBy(*at, F.col("score").alias("s")).agg(side(1).alias("p"), side(0).alias("q"))
    return rounded(agreement.average_precision(h, at))


@query(
    f"with {SHIPMENTS_SQL}, {_COHORTS}, g as (select period, score, count(*) as n from analysed group by all), names as (select distinct period from g, r where period <> base), u as (select period, score, n, 0 as m from g, r where period <> base union all select names.period, score, 0, n from names, g, r where g.period = base), "
    "h as (select period, score, sum(n) as n, sum(m) as m from u group by all), f as (select period, abs(sum(n) over w / sum(n) over t - sum(m) over w / sum(m) over t) as gap, sum(n) over t as n, sum(m) over t as m from h window w as (partition by period order by score), t as (partition by period)) "
    f"select period as cohort, max(n)::bigint as n, max(m)::bigint as n_reference, {_r('max(gap)')} as ks_d from f group by 1"
)
def score_drift(spark, sf_dir):
    a = analysed(spark, sf_dir)
    return rounded(agreement.ks_drift(a, "period", _reference(a)))


@query(
    f"with {LONG_SQL}, {_COHORTS}, g as (select period, attribute, level, count(*) as n from long where attribute <> 'overall' group by all), names as (select distinct period from g, r where period <> base), u as (select period, attribute, level, n, 0 as m from g, r where period <> base union all select names.period, attribute, level, 0, n from names, g, r where g.period = base), "
    "h as (select period, attribute, level, sum(n) as n, sum(m) as m from u group by all), s as (select period, attribute, greatest(n / sum(n) over w, 1e-4) as a, greatest(m / sum(m) over w, 1e-4) as b from h window w as (partition by period, attribute)) "
    f"select period as cohort, attribute, {_r('sum((a - b) * ln(a / b))')} as psi from s group by all"
)
def attribute_drift(spark, sf_dir):
    a = analysed(spark, sf_dir)
    return rounded(agreement.attribute_drift(a, "period", _reference(a), list(ATTRIBUTES)))


@query(
    f"with {VISITS_SQL}, d as (select event_type, score as a, prior as b, score - prior as d from visits where score is not null and prior is not null) select event_type, count(*) as n, {_r('avg(d)')} as bias, {_r('avg(d) - 1.96 * stddev_samp(d)')} as loa_low, {_r('avg(d) + 1.96 * stddev_samp(d)')} as loa_high, "
    f"{_r('avg(abs(d))')} as mae, {_r('sqrt(avg(d * d))')} as rmse, {_r('2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + pow(avg(d), 2))')} as ccc from d group by 1"
)
def paired_moments(spark, sf_dir):
    return rounded(agreement.paired_moments(visits(spark, sf_dir), ["event_type"], "score", "prior"))


@query(
    f"with {VISITS_SQL}, c as (select event_type, least(floor(score * 5), 4) as i, least(floor(prior * 5), 4) as j from visits where score is not null and prior is not null), t as (select event_type, i, j, count(*) as n from c group by all), a as (select event_type, i, sum(n) as n from t group by all), b as (select event_type, j, sum(n) as n from t group by all), "
    "s as (select event_type, sum(n) as n, sum(n) filter (i <> j) as off, sum(n * pow(i - j, 2) / 16) as far from t group by 1), e as (select event_type, sum(a.n * b.n) filter (i <> j) as off, sum(a.n * b.n * pow(i - j, 2) / 16) as far from a join b using (event_type) group by 1) "
    f"select event_type, s.n::bigint as n, {_r('1 - s.off * s.n::double / e.off')} as kappa, {_r('1 - s.far * s.n / e.far')} as kappa_weighted from s join e using (event_type)"
)
def rating_agreement(spark, sf_dir):
    fifth = lambda c: F.least(F.floor(F.col(c) * 5), F.lit(4))
    return rounded(agreement.kappa(visits(spark, sf_dir), ["event_type"], fifth("score"), fifth("prior"), 5))


@query(
    f"with {SHIPMENTS_SQL}, long as ("
    + " union all ".join(f"select '{a}' as attribute, coalesce({a}, 'Unknown/missing') as level, dataset = 'dev' as side from shipments" for a in ATTRIBUTES)
    + "), c as (select attribute, level, count(*) filter (side) as n, count(*) filter (not side) as m from long group by all), w as (select *, sum(n) over (partition by attribute) as an, sum(m) over (partition by attribute) as am from c), "
    "e as (select *, n / an as a, m / am as b, (n + m) * an / (an + am) as en, (n + m) * am / (an + am) as em from w) "
    f"select attribute, count(*) as levels, {_r('case when count(*) > 1 and max(an) > 0 and max(am) > 0 then sqrt(sum(pow(n - en, 2) / en + pow(m - em, 2) / em) / (max(an) + max(am))) end')} as cramers_v, {_r('case when count(*) > 1 and max(an) > 0 and max(am) > 0 then max(abs(a - b) / nullif(sqrt((a * (1 - a) + b * (1 - b)) / 2), 0)) end')} as smd_max from e group by 1"
)
def table_similarity(spark, sf_dir):
    return rounded(agreement.similarity(shipments(spark, sf_dir).withColumn("side", F.col("dataset") == "dev"), "side", list(ATTRIBUTES)))
