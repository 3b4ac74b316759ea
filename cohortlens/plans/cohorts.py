"""Cohorts of a binary classifier that Spark derives from the star-schema tables, and their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.counts import OperatingPoint, band, flow_state

POINTS = [OperatingPoint("op1", ">=", 0.5), OperatingPoint("op2", ">", 0.7)]
ATTRIBUTES = ["age_band", "segment", "status", "priority"]
BANDS = [(0, 10), (10, 25), (25, 40), (40, 50)]
#: Line items up to which they stay in the parts they are read in, and those of a part beyond.
FEW, PART = 2_000_000, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(items: DataFrame) -> int | None:
    """Number of parts that line items are dealt into; none for few."""
    n = items.count()
    return math.ceil(n / PART) if n > FEW else None


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: the label is the return flag (R positive, A indeterminate), the score the discount times ten
    (0 counts as missing), the prior score the tax; a case is an order; rows shipped in 1992 are ``dev``.

    Many are dealt by order into parts of a bounded size, whose number grows with the table.  Aggregates and windows
    by case then need no further shuffle, and no task holds more cases than one part has.
    """
    li, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    orders, customer = orders.select("o_orderkey", "o_custkey", "o_orderpriority"), customer.select("c_custkey", "c_mktsegment")
    of_order, of_customer = F.col("l_orderkey") == F.col("o_orderkey"), F.col("o_custkey") == F.col("c_custkey")
    n = parts(li)
    if n is None:
        d = li.join(orders, of_order).join(customer, of_customer)
    else:
        d = li.repartition(n, "l_orderkey").join(orders.join(customer, of_customer).hint("merge"), of_order)  # a broadcast would leave the parts
    d = d.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"),
        F.col("l_orderkey").alias("case_id"),
        F.col("l_returnflag").alias("y_true"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("score"),
        (F.col("l_tax") * 12.5).alias("prior"),
        F.when(F.year("l_shipdate") == 1992, "dev").otherwise("test").alias("dataset"),
        band(F.col("l_quantity"), BANDS).alias("age_band"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("l_quantity") < 49, F.col("l_linestatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.year("l_shipdate").cast("string"), F.lit("-Q"), F.quarter("l_shipdate").cast("string")).alias("period"),
    )
    return d.withColumn("flow_state", flow_state(F.col("dataset"), F.col("y_true"), F.col("score"), F.col("y_true") == "A"))


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(spark, sf_dir).where("flow_state = 'analysed'")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: the label is an error, the score its value on a scale of 500, the prior score the k of its
    properties; a case is a user and event_id is unique."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("case_id"), "ts", "event_type", (F.col("event_type") == "error").cast("int").alias("y"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("prior"))


SHIPMENTS_SQL = """
shipments as (select *, case when dataset = 'dev' then 'dev' when y_true is null then 'missing_label' when score is null then 'missing_score' when y_true = 'A' then 'indeterminate' else 'analysed' end as flow_state from (
 select l_orderkey || '-' || l_linenumber as row_id, l_orderkey as case_id, l_returnflag as y_true, (l_returnflag = 'R')::int as y, case when l_discount > 0 then l_discount * 10 end as score, l_tax * 12.5 as prior,
 case when year(l_shipdate) = 1992 then 'dev' else 'test' end as dataset,
 case when l_quantity >= 0 and l_quantity < 10 then '0-10' when l_quantity >= 10 and l_quantity < 25 then '10-25' when l_quantity >= 25 and l_quantity < 40 then '25-40' when l_quantity >= 40 and l_quantity < 50 then '40-50' else 'Unknown/missing' end as age_band,
 c_mktsegment as segment, case when l_quantity < 49 then l_linestatus end as status, o_orderpriority as priority, year(l_shipdate)::varchar || '-Q' || quarter(l_shipdate)::varchar as period
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)),
analysed as materialized (select * from shipments where flow_state = 'analysed')
"""
VISITS_SQL = """
visits as (select event_id, user_id as case_id, ts, event_type, (event_type = 'error')::int as y, least(value / 500, 1.0) as score, json_extract_string(props, '$.k')::double / 100 as prior from events)
"""
LONG_SQL = (
    SHIPMENTS_SQL
    + ", long as (select 'overall' as attribute, 'all' as level, * from analysed"
    + "".join(f" union all select '{a}', coalesce({a}, 'Unknown/missing'), * from analysed" for a in ATTRIBUTES)
    + ")"
)
COUNTS_SQL = (
    LONG_SQL
    + """, counts as materialized (select attribute, level, op, count(*) filter (y = 1 and p) as tp, count(*) filter (y = 1 and not p) as fn, count(*) filter (y = 0 and p) as fp, count(*) filter (y = 0 and not p) as tn from (
 select attribute, level, y, 'op1' as op, score >= 0.5 as p from long union all select attribute, level, y, 'op2', score > 0.7 from long) group by all)"""
)
CELLS_SQL = (
    COUNTS_SQL
    + ", cells as materialized ("
    + " union all ".join(
        f"select attribute, level, op, '{m}' as metric, {k} as k, {n} as n from counts"
        for m, k, n in (
            ("sensitivity", "tp", "tp + fn"), ("specificity", "tn", "tn + fp"), ("ppv", "tp", "tp + fp"), ("npv", "tn", "tn + fn"),
            ("accuracy", "tp + tn", "tp + fn + fp + tn"), ("selection_rate", "tp + fp", "tp + fn + fp + tn"),
        )
    )
    + ")"
)
