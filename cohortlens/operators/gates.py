"""Validation gates as one table: code, rows at fault, and whether the run halts.  Counts only, never values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.counts import OperatingPoint
from cohortlens.operators.ranks import auroc

#: Gates of one table in the order in which they are decided, after H11 and H07; W codes only warn.
ORDER = ("H02", "H03", "H05", "H06", "H01", "H04", "H08", "W10", "W06", "W13")


class Halt(ValueError):
    """A gate that stops a run; the message has its code and a count, never values."""

    def __init__(self, code: str, n: int) -> None:
        super().__init__(f"{code}: {n}")
        self.code, self.n = code, n


def gate_report(raw: DataFrame, analysed: DataFrame, classes: tuple[str, ...], point: OperatingPoint, prevalence: float, site: str, case: str, clustered: bool = True, points: int = 1, parts: int | None = None) -> DataFrame:
    """raw: y_true, score, row_id, case and perhaps y_pred, held against the classes too; analysed: y, score, y_pred_positive and the named columns.

    H05 counts duplicate row ids, or else, where cases are not declared as clusters, the rows whose label
    differs from the first of their case (by row id).  H08 counts operating points declared for a table
    whose score is nowhere filled, when they are several.  ``parts``: how many parts many rows are dealt into by row id.
    """
    unknown = [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*classes)) for c in ("y_true", "y_pred") if c in raw.columns]
    one = (raw.repartition(parts, "row_id") if parts else raw).agg(
        sum(unknown[1:], unknown[0]).alias("H02"),
        F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("H03"),
        (F.count("row_id") - F.count_distinct("row_id")).alias("repeated"),
        F.when((F.count("score") == 0) & F.lit(points > 1), points).otherwise(0).cast("long").alias("H08"),
    )
    if clustered:
        one = one.withColumnRenamed("repeated", "H05")
    else:
        labelled = raw.where(F.col(case).isNotNull() & F.col("y_true").isNotNull()).select(case, F.col("y_true").alias("y"), "row_id")
        one = one.crossJoin(conflicting_labels(labelled, case, "row_id"))  # one row each
        one = one.withColumn("H05", F.when(F.col("repeated") > 0, F.col("repeated")).otherwise(F.col("n_conflicting"))).drop("repeated", "n_conflicting")
    rate = F.avg(F.col("y").cast("double"))
    two = analysed.agg(
        F.when(F.coalesce(F.min("y") == F.max("y"), F.lit(True)), 1).otherwise(0).cast("long").alias("H06"),
        F.count_if(F.col("y_pred_positive") != point.positive(F.col("score"))).alias("H04"),
        F.when(F.abs(rate - prevalence) > 0.10, 1).otherwise(0).cast("long").alias("W10"),
        F.when(F.count_distinct(case) < F.count("*"), 1).otherwise(0).cast("long").alias("W13"),
    )
    area = auroc(analysed.withColumn("_all", F.lit("all")), ["_all"]).select(F.when(F.col("auc") < 0.5, 1).otherwise(0).cast("long").alias("H01"))
    sites = analysed.groupBy(site).agg(F.count_distinct("y").alias("c")).agg(F.count_if(F.col("c") < 2).alias("W06"))
    wide = one.crossJoin(two).crossJoin(sites).join(area, F.lit(True), "left")  # one row each
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(c).alias("code"), F.coalesce(F.col(c), F.lit(0)).alias("n"), F.lit(c[0] == "H").alias("halting")) for i, c in enumerate(ORDER)])
    return wide.select(F.explode(rows).alias("g")).select("g.*", (F.col("g.halting") & (F.col("g.n") > 0)).alias("halts"))


def halt_on(report: DataFrame) -> list[str]:
    """Raises the first gate of a gate_report() that halts; else the codes of its warnings, in order."""
    found = sorted(report.where("n > 0").collect(), key=lambda r: r["step"])  # at most one row a gate
    for r in found:
        if r["halts"]:
            raise Halt(r["code"], r["n"])
    return [r["code"] for r in found]


def pairing(new: DataFrame, prior: DataFrame, key: str, allow_unpaired: bool = False) -> DataFrame:
    """code (H12, or W12 where unpaired methods are allowed), unmatched distinct ids of both sides, halts.

    A table without the key column halts under either setting.
    """
    if key not in new.columns or key not in prior.columns:
        raise Halt("H12", 0)
    ids = lambda d, v: d.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lit(v).alias("side"))
    sides = ids(new, 1).unionByName(ids(prior, 2)).groupBy("id").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return sides.agg(F.count_if(F.col("lo") == F.col("hi")).alias("unmatched")).select(F.lit("W12" if allow_unpaired else "H12").alias("code"), "unmatched", ((F.col("unmatched") > 0) & F.lit(not allow_unpaired)).alias("halts"))


def uncovered_dates(dates: DataFrame, period: str | None) -> DataFrame:
    """code H11, date-like columns that the period declaration leaves open, and whether they halt."""
    left = dates.where(F.col("date_like") & ~F.col("column").eqNullSafe(F.lit(period)))
    return left.agg(F.count("*").alias("n")).select(F.lit("H11").alias("code"), "n", (F.col("n") > 0).alias("halts"))


def conflicting_labels(rows: DataFrame, case: str, order: str) -> DataFrame:
    """Rows whose label differs from the first one of their case, counted from per-case aggregates."""
    per = rows.groupBy(case, "y").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    firsts = per.withColumn("y0", F.first("y").over(Window.partitionBy(case).orderBy("first")))
    return firsts.agg(F.coalesce(F.sum(F.when(F.col("y") != F.col("y0"), F.col("n"))), F.lit(0)).alias("n_conflicting"))


def shared_cases(rows: DataFrame, case: str, level: str) -> DataFrame:
    """Cases that occur in more than one level of an attribute."""
    return rows.select(case, level).distinct().groupBy(case).count().agg(F.count("*").alias("cases"), F.count_if(F.col("count") > 1).alias("spanning"))


def unknown_values(rows: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Distinct non-null values of a column outside the allowed ones, with their rows."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count().join(allowed, "value", "left_anti")
