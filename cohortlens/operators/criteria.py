"""Acceptance criteria against result cells, suppression of small cells, pseudonyms and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import intervals as ci

#: Smallest counts that may leave the site; declarations may only raise them.
LEAST_N, LEAST_EVENTS, LEAST_NONEVENTS = 10, 5, 5
SHORT_TOKEN = "^[A-Za-z0-9<>=+-]{1,3}$"


class NotAdmitted(ValueError):
    """A column that may not leave; the message has its name and a count, never values."""


def evaluate(criteria: DataFrame, cells: DataFrame) -> DataFrame:
    """status and reason of each criterion (id, attribute, level, op, metric, statistic, comparator, value)."""
    on = ["attribute", "level", "op", "metric"]
    found = cells.select(*on, "n", "est", "ci_lo", "ci_hi", F.lit(True).alias("known"))
    stat = F.when(F.col("statistic") == "estimate", F.col("est")).when(F.col("statistic") == "ci_lower_bound", F.col("ci_lo")).otherwise(F.col("ci_hi"))
    out = criteria.join(found, on).unionByName(criteria.join(found, on, "left_anti"), allowMissingColumns=True)
    out = out.withColumn("stat", stat)
    holds = F.when(F.col("comparator") == ">=", F.col("stat") >= F.col("value")).when(F.col("comparator") == ">", F.col("stat") > F.col("value")).when(F.col("comparator") == "<=", F.col("stat") <= F.col("value")).otherwise(F.col("stat") < F.col("value"))
    reason = F.when(F.col("known").isNull(), "cell_not_found").when(F.col("stat").isNull(), "no_interval")
    most, meets = F.when(F.col("n") > 0, F.col("n") / (F.col("n") + ci.z_for() ** 2)), F.col("comparator").isin(">=", ">") & (F.col("statistic") == "ci_lower_bound")
    return out.select("id", *on, "stat", F.when(reason.isNotNull(), "not_assessable").when(holds, "met").otherwise("not_met").alias("status"), reason.alias("reason"), F.when(meets, most).alias("most_attainable"), F.when(meets, most >= F.col("value")).alias("attainable"))


LEAST = (LEAST_N, LEAST_EVENTS, LEAST_NONEVENTS)


def suppressed(n: Column, events: Column, nonevents: Column, least: tuple[int, int, int] = LEAST) -> Column:
    """Whether a cell is too small to show; unknown counts are.  ``least`` can only raise the limits."""
    least = tuple(map(max, least, LEAST))
    return F.coalesce((n < least[0]) | (events < least[1]) | (nonevents < least[2]), F.lit(True))


def project(cells: DataFrame, least: tuple[int, int, int] = LEAST) -> DataFrame:
    """The columns that may leave, with numbers of small cells blanked."""
    hide = suppressed(F.col("n"), F.col("k"), F.col("n") - F.col("k"), least)
    blank = lambda c: F.when(~hide, F.col(c)).alias(c)
    return cells.select("attribute", "level", "op", "metric", *[blank(c) for c in ("n", "k", "est", "ci_lo", "ci_hi")], hide.alias("suppressed"))


def egress(numbers: DataFrame, least: tuple[int, int, int] = LEAST) -> DataFrame:
    """Numbers of any kind as they may leave: block, attribute, level, op, metric, n, est, ci_lo, ci_hi, reason, suppressed.

    ``numbers`` have these (but suppressed) and the events and non-events behind each, of the smaller side where two are
    compared; where any is unknown or under its limit, the numbers and the reason are blanked.
    """
    hide = suppressed(F.col("n"), F.col("events"), F.col("nonevents"), least)
    return numbers.select("block", "attribute", "level", "op", "metric", *[F.when(~hide, F.col(c)).alias(c) for c in ("n", "est", "ci_lo", "ci_hi", "reason")], hide.alias("suppressed"))


def whitelisted(rows: DataFrame, properties: dict[str, dict]) -> DataFrame:
    """The columns that a JSON schema's ``properties`` name, once every value of them is admitted.

    Other columns are dropped.  Text must be held to a ``const``, an ``enum`` or a ``pattern`` (with at most
    ``maxLength`` characters), so that free text cannot leave; null needs the type ``null`` or an enum with
    it.  NotAdmitted names the column and the number of rows, never values; an empty table passes.
    """
    tests = {}
    for field in rows.schema.fields:
        if field.name not in properties:
            continue
        rule, x = properties[field.name], F.col(f"`{field.name}`")
        types = rule.get("type", "string" if {"const", "enum", "pattern"} & set(rule) else [])
        types = {types} if isinstance(types, str) else set(types)
        kind = field.dataType
        if isinstance(kind, T.BooleanType):
            fine = F.lit("boolean" in types)
        elif isinstance(kind, T.IntegralType):
            fine = F.lit(bool(types & {"integer", "number"}))
        elif isinstance(kind, T.NumericType):
            fine = F.lit("number" in types)
        elif not isinstance(kind, T.StringType):
            raise NotAdmitted(f"{field.name}: a column of this type cannot leave")
        elif "string" not in types:
            fine = F.lit(False)
        elif "const" in rule:
            fine = x == rule["const"]
        elif "enum" in rule:
            fine = x.isin(*[v for v in rule["enum"] if v is not None])
        elif "pattern" in rule:
            fine = x.rlike(rf"\A(?:{rule['pattern']})\z") & (F.char_length(x) <= rule.get("maxLength", 2**31 - 1))
        else:
            raise NotAdmitted(f"{field.name}: text without a constraint cannot leave")
        empty = "null" in types or None in rule.get("enum", ())
        tests[field.name] = F.when(x.isNull(), F.lit(empty)).otherwise(fine)
    if tests:
        bad = rows.agg(*[F.count_if(~t).alias(c) for c, t in tests.items()]).first().asDict()
        for name, n in bad.items():
            if n:
                raise NotAdmitted(f"{name}: {n} rows have a value that is not admitted")
    return rows.select(*[f"`{c}`" for c in tests])


def letters(rank: Column) -> Column:
    """A to Z, AA, AB, ... ZZ, AAA, ... for ranks from 1, like spreadsheet columns."""
    digits = lambda n: (F.floor((rank - 1 - sum(26**i for i in range(1, n + 1))) / 26**n) % 26).cast("int")
    at = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), digits(n) + 1, F.lit(1))
    name = at(0)
    for n in range(1, 6):  # a digit more from the rank after all shorter names on
        name = F.when(rank > sum(26**i for i in range(1, n + 1)), F.concat(at(n), name)).otherwise(name)
    return name


def pseudonyms(levels: DataFrame, always: tuple[str, ...]) -> DataFrame:
    """attribute, level, pseudonym by code-point order; short tokens of other attributes stay."""
    rank = F.dense_rank().over(Window.partitionBy("attribute").orderBy("level"))
    keep = ~F.col("attribute").isin(*always) & F.col("level").rlike(SHORT_TOKEN)
    return levels.withColumn("pseudonym", F.when(keep, F.col("level")).otherwise(F.concat(F.initcap("attribute"), F.lit(" "), letters(rank))))


def relation(lo: Column, hi: Column, est: Column) -> Column:
    """How an interval of a difference lies to 0."""
    return F.when(lo > 0, "above").when(hi < 0, "below").when(lo.isNotNull(), "within").when(est.isNotNull(), "estimate").otherwise("not_assessable")


def row_bucket(n: Column) -> Column:
    return F.when(n < 1000, "<1k").when(n < 10_000, "1k-10k").when(n <= 100_000, "10k-100k").otherwise(">100k")
