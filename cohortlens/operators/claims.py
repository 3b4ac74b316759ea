"""Claims about results: built with pointers to the numbers they state, and held against the results by joins.

``index`` flattens tables of results to a row a number, under its JSON pointer (RFC 6901) with what it is a number of.
``build`` makes one claim a number.  ``check`` joins claims, whoever wrote them, to the index by pointer and recomputes
what they say; a claim is accepted or carries the first of ``REASONS`` that holds.  Claims and index are both tables of
any size: pointers are the join key, and all that is asked of a claim as a whole is one aggregate over its pointers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reason codes, relations and states in the order in which they are looked at (fixed values).
REASONS = (
    "claim_id_invalid", "value_refs_invalid", "relation_unknown", "status_not_in_enum", "value_refs_count", "value_ref_duplicate", "value_ref_unresolved", "value_ref_suppressed",
    "metric_mismatch", "operating_point_mismatch", "relation_mismatch", "subgroup_mismatch", "status_on_non_criterion", "status_mismatch", "status_recomputation_mismatch", "claim_id_duplicate",
)
RELATIONS = ("above", "below", "within", "estimate", "not_assessable")
STATES = ("met", "not_met", "not_assessable")
#: Pointers of one claim, at most.
MOST_REFS = 4


def pointer(*parts: Column | str) -> Column:
    """A JSON pointer of the parts, ``~`` and ``/`` escaped."""
    text = [(F.lit(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.concat(*[x for p in text for x in (F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))])


def index(rows: DataFrame, block: str, difference: bool) -> DataFrame:
    """The numbers of a table with attribute, level, op, metric, est, ci_lo, ci_hi, reason, and perhaps suppressed, status and recomputed (of criteria)."""
    has = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
    at = pointer(block, F.col("attribute"), F.col("level"), F.col("op"), F.col("metric"))
    return rows.select(
        at.alias("pointer"), F.lit(block).alias("block"), F.lit(difference).alias("difference"), "attribute", "level", "op", "metric", has("est", "double"), has("ci_lo", "double"), has("ci_hi", "double"),
        has("reason", "string"), F.coalesce(has("suppressed", "boolean"), F.lit(False)).alias("suppressed"), has("status", "string"), has("recomputed", "string"),
    )


def relation_of(difference: Column) -> Column:
    """What the interval of an indexed number says: its side of 0 for a difference, else that there is an estimate."""
    closed = F.col("reason").isNull() & ~F.col("suppressed") & F.col("ci_lo").isNotNull() & F.col("ci_hi").isNotNull()
    side = F.when(F.col("ci_lo") > 0, "above").when(F.col("ci_hi") < 0, "below").otherwise("within")
    return F.when(~closed, "not_assessable").when(difference, side).otherwise("estimate")


def build(found: DataFrame) -> DataFrame:
    """A claim a number of an index: claim_id, metric_id, operating_point, attribute, level, relation, status, value_refs."""
    number = F.conv(F.substring(F.sha2("pointer", 256), 1, 12), 16, 10)  # named by what it states, so that no order is needed
    stated = F.when(F.col("status").isNotNull(), F.when(F.col("status").isin("met", "not_met"), "estimate").otherwise("not_assessable")).otherwise(relation_of(F.col("difference")))
    return found.select(F.concat(F.lit("CL-"), F.lpad(number, 15, "0")).alias("claim_id"), F.col("metric").alias("metric_id"), F.col("op").alias("operating_point"), "attribute", "level", stated.alias("relation"), "status", F.array("pointer").alias("value_refs"))


def check(claims: DataFrame, found: DataFrame) -> DataFrame:
    """claim_id, accepted and reason_code of every claim; the first number of a claim decides its relation and status."""
    rows = claims.withColumns({"claim": F.monotonically_increasing_id(), "copies": F.count("*").over(Window.partitionBy("claim_id"))})
    refs = F.coalesce("value_refs", F.array().cast("array<string>"))
    wide = rows.withColumn("refs", refs)
    one = wide.select("claim", "claim_id", "copies", "metric_id", "operating_point", "attribute", "level", "relation", "status", F.col("value_refs").isNull().alias("no_refs"), F.size("refs").alias("n"), (F.size(F.array_distinct("refs")) < F.size("refs")).alias("twice"), F.posexplode_outer("refs").alias("at", "pointer"))
    number = found.select("pointer", F.struct(*[c for c in found.columns if c != "pointer"]).alias("of"))
    one = one.join(number, "pointer", "left")
    # the facts of a claim, over its pointers
    differs = lambda mine, theirs: F.coalesce(F.bool_or(F.col("of").isNotNull() & ~F.col(mine).eqNullSafe(F.col(f"of.{theirs}"))), F.lit(False))
    lead = F.min(F.when(F.col("at") == 0, F.col("of")))
    facts = one.groupBy("claim").agg(
        *[F.first(c).alias(c) for c in ("claim_id", "copies", "relation", "status", "no_refs", "n", "twice")], lead.alias("of"),
        F.bool_or(F.col("pointer").isNotNull() & F.col("of").isNull() | F.col("pointer").isNull() & (F.col("n") > 0)).alias("unresolved"), F.coalesce(F.bool_or("of.suppressed"), F.lit(False)).alias("hidden"),
        differs("metric_id", "metric").alias("metric"), differs("operating_point", "op").alias("op"), (differs("attribute", "attribute") | differs("level", "level")).alias("subgroup"),
    )
    facts = facts.select("*", *[F.col(f"of.{c}").alias(c) for c in ("reason", "suppressed", "ci_lo", "ci_hi", "difference", "recomputed")], F.col("of.status").alias("kept"))
    criterion = F.col("kept").isNotNull()
    expected = F.when(criterion, F.when(F.col("kept").isin("met", "not_met"), "estimate").otherwise("not_assessable")).otherwise(relation_of(F.col("difference")))
    holds = {
        "claim_id_invalid": ~F.coalesce(F.col("claim_id").rlike(r"^CL-\d{4,}$"), F.lit(False)), "value_refs_invalid": F.col("no_refs"),
        "relation_unknown": ~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)), "status_not_in_enum": F.col("status").isNotNull() & ~F.col("status").isin(*STATES),
        "value_refs_count": ~F.col("n").between(1, MOST_REFS), "value_ref_duplicate": F.col("twice"), "value_ref_unresolved": F.col("unresolved"), "value_ref_suppressed": F.col("hidden"),
        "metric_mismatch": F.col("metric"), "operating_point_mismatch": F.col("op"), "relation_mismatch": F.col("relation") != expected, "subgroup_mismatch": F.col("subgroup"),
        "status_on_non_criterion": F.col("status").isNotNull() & ~criterion, "status_mismatch": criterion & ~F.col("status").eqNullSafe(F.col("kept")),
        "status_recomputation_mismatch": criterion & F.col("recomputed").isNotNull() & ~F.col("kept").eqNullSafe(F.col("recomputed")), "claim_id_duplicate": F.col("copies") > 1,
    }
    code = reduce(lambda chain, r: chain.when(F.coalesce(holds[r], F.lit(False)), r), REASONS[1:], F.when(holds[REASONS[0]], REASONS[0]))
    return facts.select("claim_id", code.isNull().alias("accepted"), code.alias("reason_code"))
