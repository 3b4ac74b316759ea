"""Registered queries of what leaves the engine: leak scans and comparisons of runs, over files they write first."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import calibration, claims, counts, criteria, leaks, ranks
from cohortlens.plans.cohorts import analysed, table
from cohortlens.plans.queries import _DIFF_SQL, ORACLES, _areas, _cells, _differences, query, rounded
from cohortlens.session import scratch
from cohortlens.sources import canonical


@query(
    """select n_name as needle, form, count(*) as hits from customer join nation on c_nationkey = n_nationkey, (values ('utf8'), ('json_ascii'), ('json_utf8')) as f(form)
    where c_custkey % 3 <> 0 group by all"""
)
def leaked_names(spark, sf_dir):
    """Names of nations in a written table that hides them from every third row only."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    path = scratch(spark)
    canonical.write_lines(rows.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("<"), "n_name", F.lit(">"))).alias("site")), path, ["c_custkey"])
    found = leaks.scan(spark, path, nations.select(F.col("n_name").alias("needle"), F.concat(F.lit("<"), "n_name", F.lit(">")).alias("text")))
    return found.groupBy("needle", "form").agg(F.sum("hits").alias("hits"))


@query(
    """with a as (select o_orderkey, o_orderstatus as status, o_orderpriority as priority, o_custkey as rank from orders where o_orderkey % 1501 <> 3),
    b as (select o_orderkey, case when o_orderkey % 997 = 5 then 'changed' else o_orderstatus end as status, o_orderpriority as priority, o_custkey + case when o_orderkey % 499 = 1 then 1 else 0 end as rank from orders where o_orderkey % 1501 <> 4),
    u as (select coalesce(a.o_orderkey, b.o_orderkey) as k, unnest([{'c': 'status', 'x': '"' || a.status || '"', 'y': '"' || b.status || '"'}, {'c': 'priority', 'x': '"' || a.priority || '"', 'y': '"' || b.priority || '"'}, {'c': 'rank', 'x': a.rank::varchar, 'y': b.rank::varchar}]) as u from a full join b on a.o_orderkey = b.o_orderkey)
    select '{"o_orderkey":' || k || '}' as key, u.c as "column", u.x as before, u.y as after from u where u.x is distinct from u.y"""
)
def changed_cells(spark, sf_dir):
    """Two kept runs over the orders, the second with some cells and rows changed, compared by their trees."""
    orders = table(spark, sf_dir, "orders")
    key, status, rank = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey")
    first = orders.where(key % 1501 != 3).select(key, status.alias("status"), F.col("o_orderpriority").alias("priority"), rank.alias("rank"), F.lit("run 1").alias("started"))
    second = orders.where(key % 1501 != 4).select(key, F.when(key % 997 == 5, "changed").otherwise(status).alias("status"), F.col("o_orderpriority").alias("priority"), (rank + F.when(key % 499 == 1, 1).otherwise(0)).alias("rank"), F.lit("run 2").alias("started"))
    paths = scratch(spark), scratch(spark)
    for rows, path in zip((first, second), paths, strict=True):
        canonical.write_run(rows, path, ["o_orderkey"], ("started",))
    return canonical.compare(spark, *paths)


@query(
    f"""with {_DIFF_SQL}, d as (select *, concat('/differences/', replace(replace(attribute, '~', '~0'), '/', '~1'), '/', replace(replace(level, '~', '~0'), '/', '~1'), '/', op, '/', metric) as pointer from diffs where against = 'reference')
    select pointer, 'CL-' || lpad(('0x' || substr(sha256(pointer), 1, 12))::bigint::varchar, 15, '0') as claim_id, case substr(md5(pointer), 1, 1) when '0' then 'value_ref_unresolved' when '1' then 'relation_mismatch' when '2' then 'metric_mismatch' when '3' then 'operating_point_mismatch'
      when '4' then 'subgroup_mismatch' when '5' then 'value_ref_duplicate' when '6' then 'status_on_non_criterion' when '7' then 'claim_id_invalid' end as reason_code from d"""
)
def claim_verdicts(spark, sf_dir):
    """A claim a difference, half of them forged in a way that their pointer's hash picks, held against the results."""
    found = claims.index(_differences(spark, sf_dir).where("against = 'reference'").drop("against"), "differences", True)
    made = claims.build(found)
    pick = F.instr(F.lit("01234567"), F.substring(F.md5(F.col("value_refs")[0]), 1, 1))  # 1 to 8, else 0
    forged = lambda k, value, column: F.when(pick == k, value).otherwise(F.col(column)).alias(column)
    refs = F.col("value_refs")
    stated = made.select(
        F.when(pick == 8, F.concat(F.lit("X"), "claim_id")).otherwise(F.col("claim_id")).alias("claim_id"), F.col("claim_id").alias("own"), refs[0].alias("pointer"), forged(3, F.lit("auroc"), "metric_id"), forged(4, F.lit("op9"), "operating_point"), "attribute", forged(5, F.lit("none"), "level"),
        forged(2, F.when(F.col("relation") == "above", "below").otherwise("above"), "relation"), forged(7, F.lit("met"), "status"), F.when(pick == 1, F.array(F.concat(refs[0], F.lit("/x")))).when(pick == 6, F.concat(refs, refs)).otherwise(refs).alias("value_refs"),
    )
    verdicts = claims.check(stated.drop("own", "pointer"), found)
    own = stated.select("claim_id", "own", "pointer")
    return verdicts.join(own, "claim_id").select("pointer", F.col("own").alias("claim_id"), "reason_code")


_SHOWN = "case when not hide then {} end as {}"
_EGRESS = ", ".join(_SHOWN.format(c, c) for c in ("n", "est", "ci_lo", "ci_hi", "reason"))


@query(
    f"""with c as ({ORACLES["suppressed_cells"]}), a as ({ORACLES["auroc_intervals"]}), s as ({ORACLES["calibration_summary"]}),
    p as (select 'areas' as block, attribute, level, null::varchar as op, 'auroc' as metric, n_pos + n_neg as n, auc as est, ci_lo, ci_hi, reason, n_pos + n_neg < 10 or n_pos < 5 or n_neg < 5 as hide from a
      union all select 'calibration', 'overall', 'all', null, 'oe', n, oe, oe_lo, oe_hi, reason, n < 10 or events < 5 or n - events < 5 from s union all select 'calibration', 'overall', 'all', null, 'brier', n, brier, null, null, reason, n < 10 or events < 5 or n - events < 5 from s)
    select 'proportions' as block, attribute, level, op, metric, n, est, ci_lo, ci_hi, null::varchar as reason, suppressed from c union all select block, attribute, level, op, metric, {_EGRESS}, hide from p"""
)
def egress_numbers(spark, sf_dir):
    """Proportions, areas and calibration of every level as they may leave, small cells blanked."""
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda rows, block, metric, est, lo, hi, n, events, nonevents, op=None, reason=None: rows.select(
        F.lit(block).alias("block"), "attribute", "level", (none("string") if op is None else op).alias("op"), metric.alias("metric"), n.cast("long").alias("n"), events.alias("events"), nonevents.alias("nonevents"), est.alias("est"), lo.alias("ci_lo"), hi.alias("ci_hi"), (none("string") if reason is None else reason).alias("reason")
    )
    c = F.col
    cells = shape(counts.with_wilson(_cells(spark, sf_dir)), "proportions", c("metric"), c("est"), c("ci_lo"), c("ci_hi"), c("n"), c("k"), c("n") - c("k"), c("op"))
    areas = shape(ranks.auroc_interval(_areas(spark, sf_dir)), "areas", F.lit("auroc"), c("auc"), c("ci_lo"), c("ci_hi"), c("n_pos") + c("n_neg"), c("n_pos"), c("n_neg"), reason=c("reason"))
    whole = calibration.summary(analysed(spark, sf_dir).withColumns({"attribute": F.lit("overall"), "level": F.lit("all")}), ["attribute", "level"])
    two = F.explode(F.array(F.struct(F.lit("oe").alias("metric"), c("oe").alias("est"), c("oe_lo").alias("lo"), c("oe_hi").alias("hi")), F.struct(F.lit("brier").alias("metric"), c("brier").alias("est"), none("double").alias("lo"), none("double").alias("hi"))))
    whole = whole.select("attribute", "level", "n", "events", "reason", two.alias("x"))
    fit = shape(whole, "calibration", c("x.metric"), c("x.est"), c("x.lo"), c("x.hi"), c("n"), c("events"), c("n") - c("events"), reason=c("reason"))
    return rounded(criteria.egress(cells.unionByName(areas).unionByName(fit)))
