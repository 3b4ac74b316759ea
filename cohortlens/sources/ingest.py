"""Reading flat tables as text and giving their columns types, with counts of what does not fit."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import splits

#: Cells that count as missing after trimming (fixed values).
MISSING = ("", "NA", "N/A", "na", "n/a", "NaN", "nan", "null", "NULL", "None", "unknown", "Unknown", "UNKNOWN", "missing", "Missing")
_BLANK = r"[\s\x1c-\x1f\x85 \p{Z}]"
_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
#: Header words that name a role (fixed values).
SYNONYMS = {
    "y_true": ("label", "truth", "gt", "ground_truth", "outcome", "target", "reference", "y", "sepsis_label", "readmitted"),
    "score": ("prob", "probability", "p1", "pred_prob", "confidence", "output", "risk", "predicted_probability"),
    "y_pred": ("prediction", "predicted", "pred_label", "class", "predicted_label"),
    "sex": ("gender",),
    "site": ("centre", "center", "hospital", "institution", "facility", "hospital_system"),
    "device": ("scanner", "manufacturer", "vendor", "model_name"),
    "case_id": ("patient_id", "subject_id", "study_id", "mrn_hash"),
}


#: Words inside a header that suggest a role without naming it (fixed values).
TOKENS = {
    "case_id": ("patient", "subject", "mrn"), "age": ("age",), "sex": ("sex", "gender"), "y_true": ("label", "outcome", "truth"),
    "score": ("prob", "probability", "risk", "score"), "y_pred": ("pred", "prediction"), "site": ("site", "hospital", "centre", "center"),
}
ROLES = (
    "y_true", "score", "y_pred", "row_id", "case_id", "age", "age_band", "sex", "race", "ethnicity", "site", "device", "protocol", "severity", "event_date", "period", "model_version", "dataset", "indeterminate",
)
#: Words of a header, and shapes of a whole column's cells, that mean dates (fixed values).
DATE_HEADER = r"(?i)(^|_)(date|dt|time|timestamp|datetime|dob)($|_)"
#: Month words of written dates, lower case.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
DATE_SHAPES = (
    r"^\d{4}-\d{2}-\d{2}",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{1,2}\.\d{1,2}\.\d{4}$",
)


def written_date(cell: Column) -> Column:
    """Whether a cell is a day, a month's word and a four-digit year."""
    words = F.split(F.lower(cell), r"\s+")
    return (F.size(words) == 3) & F.get(words, F.lit(0)).rlike(r"^\d{1,2}$") & F.get(words, F.lit(1)).isin(*MONTHS) & F.get(words, F.lit(2)).rlike(r"^\d{4}$")


def date_tests(cell: Column) -> list[Column]:
    """One test a shape in which all filled cells of a date column may be."""
    return [*[cell.rlike(shape) for shape in DATE_SHAPES], written_date(cell)]


def age_range(cell: Column) -> Column:
    """Whether a cell reads as a range of ages: two whole numbers of at most three digits, or one and a plus;
    the range may stand in brackets and its dash be an en dash."""
    bare = F.regexp_replace(cell, r"[\s\[\])]", "")
    ends = F.split(F.translate(bare, "\u2013", "-"), "-")
    number = lambda x: x.rlike(r"^\d{1,3}$")
    return ((F.size(ends) == 2) & number(F.get(ends, F.lit(0))) & number(F.get(ends, F.lit(1)))) | bare.rlike(r"^\d{1,3}\+$")


#: Pairs of label values that a whole column may consist of (fixed values, lower case).
LABEL_PAIRS = (("0", "1"), ("true", "false"), ("yes", "no"), ("pos", "neg"), ("positive", "negative"))
#: Values of a sex column that need no dictionary (fixed values, lower case).
SEXES = ("m", "f", "male", "female")


class InputError(ValueError):
    """A table that cannot be read; the message has a code and counts, never values."""


def normalise(cell: Column) -> Column:
    """Trimmed of all Unicode white space; missing tokens become null."""
    trimmed = F.regexp_replace(cell, f"^{_BLANK}+|{_BLANK}+$", "")
    return F.when(~trimmed.isin(*MISSING), trimmed)


def to_double(cell: Column) -> Column:
    """A plain decimal number, digits grouped by single underscores allowed; null otherwise."""
    return F.when(cell.rlike(_NUMBER), F.regexp_replace(cell, "_", "").try_cast("double"))


def to_flag(cell: Column) -> Column:
    d = to_double(cell)
    return F.when(d.isin(0.0, 1.0), d.cast("byte"))


def coarsen(date: Column, granularity: str) -> Column:
    """An ISO date as YYYY, YYYY-MM or YYYY-Qn; null when it is none."""
    year, month = F.regexp_extract(date, r"^(\d{4})-(\d{2})-\d{2}", 1), F.regexp_extract(date, r"^(\d{4})-(\d{2})-\d{2}", 2)
    m = month.try_cast("int")
    text = {"year": year, "month": F.concat(year, F.lit("-"), month), "quarter": F.concat(year, F.lit("-Q"), F.ceil(m / 3).cast("string"))}[granularity]
    return F.when((year != "") & m.between(1, 12), text)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty cells null; duplicate headers and rows of another width are refused; blank rows are
    skipped.  Byte ranges of a file are read in parallel, line breaks within quotes included."""
    found = splits.records(spark, path, splits.CSV)
    header = found.where("first").select("values").first()  # any file's: they have to agree
    if header is None:
        raise InputError("S04: no header row")
    names = [x.lstrip("\ufeff").strip() for x in header["values"]]
    if len(set(names)) < len(names):
        raise InputError(f"S04: {len(names) - len(set(names))} duplicate headers")
    blank = ~F.exists("values", lambda c: c.rlike(f"^{_BLANK}*[^\\s\x1c-\x1f\x85\\p{{Z}}]"))
    width = F.size("values") != len(names)
    bad, other = found.agg(F.count_if(~F.col("first") & ~blank & width), F.count_if(F.col("first") & (F.col("values") != F.lit(header["values"])))).first()
    if bad:
        raise InputError(f"S04: {bad} rows of another width than {len(names)}")
    if other:
        raise InputError(f"S04: {other} files with other headers")
    rows = found.where(~F.col("first") & ~blank)
    return rows.select(*[F.nullif(F.col("values")[i], F.lit("")).alias(n) for i, n in enumerate(names)])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of row objects, or one object of columns; scalars become text.  A list's byte ranges are read in parallel;
    an object of columns is one task a file, as its cells only meet at its end."""
    shape = spark.read.option("lineSep", "}").text(path).where(F.col("value").rlike(r"\S")).select(F.substring(F.regexp_replace("value", "^[\\s\ufeff]+", ""), 1, 1)).first()
    if shape is None:
        raise InputError("S04: no rows")
    if shape[0] == "{":
        df = spark.read.json(path, multiLine=True, primitivesAsString=True)
        if df.columns != ["columns"] or not isinstance(df.schema["columns"].dataType, T.StructType):
            raise InputError("S04: neither a list of rows nor an object of columns")
        names = df.schema["columns"].dataType.names
        sizes = df.select(*[F.size(F.col("columns")[n]) for n in names]).first()
        if sizes is None or len(set(sizes)) > 1:
            raise InputError("S04: ragged columns")
        return df.select(F.inline(F.arrays_zip(*[F.col("columns")[n].alias(n) for n in names])))
    found = splits.records(spark, path, splits.JSON)
    keys = found.select("file", "start", "number", F.posexplode("keys").alias("at", "key")).groupBy(F.trim("key").alias("key"))
    keys = keys.agg(F.min(F.struct("file", "start", "number", "at")).alias("seen")).orderBy("seen").collect()  # a row a column
    if not keys:
        raise InputError("S04: no rows")
    rows = found.select(F.map_from_arrays("keys", "values").alias("cells"))
    return rows.select(*[F.col("cells")[F.lit(r["key"])].alias(r["key"]) for r in keys])


def typed(raw: DataFrame, doubles: Iterable[str] = (), flags: Iterable[str] = ()) -> DataFrame:
    """Every cell normalised, the named columns cast, and the count of cells that did not fit in ``n_bad``."""
    doubles, flags = set(doubles), set(flags)
    out, bad = {}, F.lit(0)
    for c in raw.columns:
        cell = normalise(F.col(f"`{c}`"))
        cast = to_double(cell) if c in doubles else to_flag(cell) if c in flags else cell
        out[c] = cast
        if c in doubles or c in flags:
            bad = bad + (cell.isNotNull() & cast.isNull()).cast("int")
    return raw.select(*[v.alias(c) for c, v in out.items()], bad.alias("n_bad"))


def control_characters(raw: DataFrame) -> DataFrame:
    """column, rows that hold a C0, DEL or C1 character after trimming, in one pass."""
    one = raw.agg(*[F.count_if(F.regexp_replace(F.col(f"`{c}`"), f"^{_BLANK}+|{_BLANK}+$", "").rlike("[\\x00-\\x1f\\x7f-\\x9f]")).alias(c) for c in raw.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in raw.columns])).alias("x")).select("x.*")


def normalise_header(name: str) -> str:
    """BOM and space dropped, camel case split, separators to underscores, case folded."""
    name = unicodedata.normalize("NFC", name.lstrip("﻿")).strip()
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return re.sub(r"[\s\-./]+", "_", name).strip("_").casefold()


def header_claims(names: Iterable[str]) -> dict[str, tuple[str, str]]:
    """Header -> (role, source) of those that claim a role: by name (canonical, synonym), as a date, or by the first of
    their words that suggests one (partial)."""
    by_token = {word: role for role, words in TOKENS.items() for word in words}
    claims: dict[str, tuple[str, str]] = {}
    for name in names:
        whole = normalise_header(name)
        key = re.sub(r"^(pt|patient|pat|subject|subj)_(?!id$)|_v\d+$", "", whole)
        synonym = next((r for r, words in SYNONYMS.items() if key in words or key.replace("_", "") in {w.replace("_", "") for w in words}), None)
        token = next((by_token[w] for w in whole.split("_") if w in by_token), None)
        if key in ROLES or re.match(r"^(attr|rater)_[a-z0-9_]+$", key):
            claims[name] = (key, "canonical" if key == whole else "synonym")
        elif synonym:
            claims[name] = (synonym, "synonym")
        elif re.search(DATE_HEADER, name):
            claims[name] = ("event_date", "date_header")
        elif token:
            claims[name] = (token, "partial")
    return claims


def map_headers(names: Iterable[str]) -> dict[str, tuple[str, str]]:
    """Header -> (role or 'ignored', confidence); a role that several headers claim, or one only suggests, is low."""
    names = list(names)
    claims = header_claims(names)
    held = [r for r, _ in claims.values()]
    level = lambda n: "low" if held.count(claims[n][0]) > 1 or claims[n][1] == "partial" else "high"
    return {n: (claims[n][0], level(n)) if n in claims else ("ignored", "none") for n in names}


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column of text: n, n_missing, n_unique and the inferred type, in one pass."""
    kinds = {"int": r"^[+-]?\d+$", "float": _NUMBER, "date": r"^\d{4}-\d{2}-\d{2}"}
    cells = []
    for c in columns:
        x = F.col(c).cast("string")
        tests = [F.coalesce(F.bool_and(x.rlike(p)), F.lit(False)) for p in kinds.values()]
        kind = F.when(F.count(x) == 0, "empty").when(tests[0], "int").when(tests[1], "float").when(tests[2], "date").when(F.count_distinct(x) * 2 > F.count(x), "string").otherwise("categorical")
        cells.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.count_distinct(x).alias("n_unique"), kind.alias("type")).alias(c))
    return df.agg(*cells).select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def top_values(df: DataFrame, column: str, k: int = 20, least: int = 10, order: str | None = None) -> DataFrame:
    """The k most frequent values; those of fewer than ``least`` rows are shown as <suppressed>.  Of equally frequent
    ones that which appears first by ``order`` comes first, without it the smaller one."""
    value = F.col(column).cast("string")
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), (F.min(order) if order else F.first(value)).alias("tie")).where("value is not null").orderBy(F.desc("n"), "tie").limit(k)
    return counts.select(F.when(F.col("n") >= least, F.col("value")).otherwise("<suppressed>").alias("value"), "n", F.row_number().over(Window.orderBy(F.desc("n"), "tie")).alias("rank"))


def date_like(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, date_like: a header that says so, or every filled cell of one column in one of the date shapes."""
    cells = []
    for c in columns:
        x = F.col(f"`{c}`").cast("string")
        shaped = F.lit(False)
        for test in date_tests(x):
            shaped = shaped | test
        named = c == "event_date" or re.search(DATE_HEADER, c) is not None
        cells.append((F.lit(True) if named else F.coalesce(F.bool_and(shaped), F.lit(False))).alias(c))
    one = df.agg(F.count("*").alias("_n"), *cells)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("date_like")) for c in columns])).alias("d")).select("d.*")


def value_signals(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_filled, n_unique, type (empty, int, float, date, text) and what all filled cells have in common.

    Cells are counted per column and value first, so a frequent value is one row of the shuffle.  A column
    without filled cells is empty and has no signals; an empty table gives no rows.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    sizes = df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("rows"))
    v, number, low = F.col("value"), to_double(F.col("value")), F.lower("value")
    every = lambda test: F.coalesce(F.bool_and(F.when(v.isNotNull(), test)), F.lit(False))
    labels, dates = F.lit(False), F.lit(False)
    for one, other in LABEL_PAIRS:
        labels = labels | (every(low.isin(one, other)) & F.bool_or(low == one) & F.bool_or(low == other))
    for test in date_tests(v):
        dates = dates | every(test)
    out = sizes.groupBy("column").agg(
        F.sum("rows").alias("n"),
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("rows"))), F.lit(0)).alias("n_filled"),
        F.count(v).alias("n_unique"),
        every(v.rlike(r"^[+-]?\d+$")).alias("whole"),
        every(number.isNotNull()).alias("numbers"),
        every(F.coalesce(number.between(0, 1), F.lit(False))).alias("unit"),
        dates.alias("dates"),
        labels.alias("labels"),
        every(F.coalesce(number.isin(0.0, 1.0), F.lit(False))).alias("flags"),
        every(low.isin(*SEXES)).alias("sexes"),
        every(age_range(v)).alias("bands"),
    )
    kind = F.when(F.col("n_filled") == 0, "empty").when(F.col("whole"), "int").when(F.col("numbers"), "float").when(F.col("dates"), "date").otherwise("text")
    return out.withColumn("type", kind)


def propose(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, role, confidence, source: what headers claim, held against all values, or else what values suggest.

    A header's role is high where the values agree, low where they contradict it or another header claims it
    too, and of an undecided column (empty, or a coded sex) high for canonical names and medium for synonyms.
    A role that a word inside the header suggests is medium where the values agree and no other header has it, else low.
    A role by values alone is medium, low where several columns suggest it, and left out where a header has it.
    Headers that are the same once normalised are refused (H07), and so are two that name the case (E01).
    """
    if len({normalise_header(c) for c in columns}) < len(columns):
        raise InputError("H07: headers are the same once normalised")
    said = header_claims(columns)
    if sum(r == ("case_id", s) and s != "partial" for r in said.values() for s in ("canonical", "synonym")) > 1:
        raise InputError("E01: several headers name the case")
    claims = {c: r for c, (r, _) in said.items()}
    rows = [F.struct(F.lit(c).alias("column"), F.lit(claims.get(c)).cast("string").alias("claim"), F.lit(said.get(c, ("", ""))[1]).alias("said")) for c in columns]
    named = df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    s = named.join(value_signals(df, columns), "column", "left").fillna({"type": "empty", "n_filled": 0})  # no rows: all are empty
    claim, kind = F.col("claim"), F.col("type")
    numeric = kind.isin("int", "float")
    role = F.when((claim == "age") & F.col("bands"), "age_band").when((claim == "age_band") & numeric, "age").otherwise(claim)
    against = (
        F.when(kind == "empty", False)
        .when(role.isin("y_true", "y_pred"), ((kind == "float") & (F.col("n_unique") > 2)) | (F.col("n_unique") > 10))
        .when(role == "score", ~numeric | F.col("flags"))
        .when(role == "age", ~numeric)
        .when(role == "event_date", ~F.col("dates"))
        .otherwise(False)
    )
    open_ = (kind == "empty") | ((role == "sex") & ~F.col("sexes"))
    value = (
        F.when(F.col("n_filled") < 2, F.lit(None).cast("string"))
        .when(F.col("labels") & (F.col("n_unique") >= 2), "y_true")
        .when((kind == "float") & F.col("unit") & (F.col("n_unique") > 2), "score")
        .when(F.col("dates"), "event_date")
        .when((kind == "int") & (F.col("n_unique") == F.col("n")), "row_id")
    )
    taken = F.coalesce(value.isin(*sorted(set(claims.values()))), F.lit(False)) if claims else F.lit(False)
    s = s.withColumns({"by_name": role, "by_value": F.when(claim.isNull() & ~taken, value), "against": against, "open": open_})
    alone = lambda c: F.count(c).over(Window.partitionBy(c)) == 1  # noqa: E731  (one row a column)
    partial, canonical = F.col("said") == "partial", F.col("said") == "canonical"
    held = F.count_if(~partial).over(Window.partitionBy("by_name"))
    others = F.when(partial, ~alone("by_name")).otherwise(held > 1)  # a mere suggestion takes nothing from a name
    name_level = F.when(others | F.col("against") | (partial & F.col("open")), "low").when(partial | F.col("open") & ~canonical, "medium").otherwise("high")
    level = F.when(F.col("by_name").isNotNull(), name_level).when(F.col("by_value").isNull(), "high").when(alone("by_value"), "medium").otherwise("low")
    source = F.when(F.col("by_name").isNotNull(), F.col("said")).when(F.col("by_value").isNotNull(), "values").otherwise("none")
    return s.select("column", F.coalesce("by_name", "by_value", F.lit("ignored")).alias("role"), level.alias("confidence"), source.alias("source"))


def settle(proposal: DataFrame, confirmed: dict[str, str]) -> dict[str, str]:
    """Column -> role for renamed(): confirmed roles, and proposed ones of high confidence; H07 where one is open."""
    found = {r["column"]: r for r in proposal.collect()}  # one row a column
    stray = [c for c in confirmed if c not in found]
    left = [c for c, r in found.items() if r["confidence"] != "high" and c not in confirmed]
    if stray or left:
        raise InputError(f"H07: {len(left)} roles are not confirmed, {len(stray)} confirmations have no column")
    return {c: confirmed.get(c, r["role"]) for c, r in found.items()}


def write_mapping(path: str, roles: dict[str, str]) -> str:
    """Writes confirmed roles as JSON and returns the SHA-256 of its bytes."""
    data = json.dumps({"version": 1, "roles": roles}, ensure_ascii=False, indent=1).encode()
    with open(path, "wb") as f:
        f.write(data)
    return hashlib.sha256(data).hexdigest()


def read_mapping(path: str, columns: list[str]) -> tuple[dict[str, str], str]:
    """The roles of a mapping file and its hash; H07 where it is not one or names other columns than the table."""
    with open(path, "rb") as f:
        data = f.read()
    try:
        roles = json.loads(data)["roles"]
        fits = all(isinstance(x, str) for x in roles.values()) and set(roles) == set(columns)
    except (ValueError, KeyError, TypeError, AttributeError):
        fits = False
    if not fits:
        raise InputError("H07: the mapping file does not fit the table")
    return roles, hashlib.sha256(data).hexdigest()


def extremes(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """column, lowest, highest of numbers and ISO dates as text; one held by fewer than ``least`` rows is <suppressed>.

    Dates are shown by month, and a month counts the rows of all its days.  Columns of another type give nulls.
    """
    parts = []
    for c in columns:
        x = F.col(f"`{c}`").cast("string")
        parts.append(F.struct(F.lit(c).alias("column"), to_double(x).alias("number"), coarsen(x, "month").alias("month"), x.isNotNull().alias("filled")))
    long = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*").where("filled")
    sizes = long.groupBy("column", "number", "month").agg(F.count("*").alias("n"))
    ends = {}
    for name, pick in (("lowest", F.min), ("highest", F.max)):
        for kind in ("number", "month"):
            value = F.when(F.col(kind).isNotNull(), F.struct(kind, "n"))
            ends[f"{name}_{kind}"] = pick(value)
    whole = {k: F.count_if(F.col(k).isNull()) == 0 for k in ("number", "month")}
    out = sizes.groupBy("column").agg(*[v.alias(k) for k, v in ends.items()], *[v.alias(f"all_{k}") for k, v in whole.items()])

    def shown(name: str) -> Column:
        cases = F.lit(None).cast("string")
        for kind in ("month", "number"):
            end = F.col(f"{name}_{kind}")
            cases = F.when(F.col(f"all_{kind}"), F.when(end["n"] >= least, end[kind].cast("string")).otherwise("<suppressed>")).otherwise(cases)
        return cases

    return out.select("column", shown("lowest").alias("lowest"), shown("highest").alias("highest"))


def renamed(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Columns by their confirmed role; ignored ones keep their name, prefixed where it reads as a role.

    Two columns of one role are refused with H07, two case ids with E01.
    """
    held = [r for r in roles.values() if r != "ignored"]
    twice = sorted({r for r in held if held.count(r) > 1})
    if twice:
        raise InputError("E01: two columns are mapped to case_id" if "case_id" in twice else f"H07: {len(twice)} roles have several columns")
    unknown = [c for c in roles if c not in df.columns]
    if unknown:
        raise InputError(f"H07: {len(unknown)} mapped columns are not in the table")
    names = {c: roles.get(c, "ignored") for c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(r if r != "ignored" else f"ignored:{c}" if c in held or map_headers([c])[c][0] != "ignored" else c) for c, r in names.items()])


#: A text column with more than two values, of which over this share of its filled cells are distinct, is free text (fixed value).
FREE_TEXT_SHARE = 0.5


def summaries(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """column, type, n, n_missing, missing_pct, n_unique, free_text, values_shown, n_suppressed_values and split.

    Values of free text and of dates are never shown.  n_suppressed_values counts the distinct values held by fewer
    than ``least`` rows; split lists the values of a column of one or two, as value:rows by falling count, with
    rare ones as <suppressed>:how many.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), normalise(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])
    sizes = df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("rows"))
    v, filled = F.col("value"), F.col("value").isNotNull()
    every = lambda test: F.coalesce(F.bool_and(F.when(filled, test)), F.lit(False))
    dates = F.lit(False)
    for test in date_tests(v):
        dates = dates | every(test)
    rare = filled & (F.col("rows") < least)
    shown = F.when(filled & ~rare, F.struct((-F.col("rows")).alias("less"), "value"))
    out = sizes.groupBy("column").agg(
        F.sum("rows").alias("n"), F.coalesce(F.sum(F.when(~filled, F.col("rows"))), F.lit(0)).alias("n_missing"), F.count(v).alias("n_unique"),
        every(v.rlike(r"^[+-]?\d+$")).alias("whole"), every(to_double(v).isNotNull()).alias("numbers"), dates.alias("dates"), F.count_if(rare).alias("n_rare"),
        F.min(shown).alias("first"), F.max(shown).alias("last"),
    )
    there = F.col("n") - F.col("n_missing")
    kind = F.when(there == 0, "empty").when(F.col("whole"), "int").when(F.col("numbers"), "float").when(F.col("dates"), "date").when(F.col("n_unique") * 2 > there, "string").otherwise("categorical")
    out = out.withColumn("type", kind)
    free = F.col("type").isin("string", "categorical") & (F.col("n_unique") > 2) & (F.col("n_unique") > FREE_TEXT_SHARE * there)
    out = out.withColumn("free_text", free).withColumn("values_shown", ~F.col("free_text") & (F.col("type") != "date"))
    item = lambda x: F.concat_ws(":", x["value"], -x["less"])
    second = F.when(F.col("last") != F.col("first"), item(F.col("last")))
    split = F.concat_ws(",", F.when(F.col("first").isNotNull(), item(F.col("first"))), second, F.when(F.col("n_rare") > 0, F.concat(F.lit("<suppressed>:"), F.col("n_rare"))))
    two = F.col("values_shown") & F.col("n_unique").between(1, 2)
    return out.select("column", "type", "n", "n_missing", F.round(100.0 * F.col("n_missing") / F.col("n"), 2).alias("missing_pct"), "n_unique", "free_text", "values_shown", F.when(F.col("values_shown"), F.col("n_rare")).otherwise(0).alias("n_suppressed_values"), F.when(two, split).alias("split"))


def control_findings(raw: DataFrame, order: str) -> DataFrame:
    """column, n and first (U+ and four digits) of the columns with a control character: the first one of the first
    such row by ``order``.  Any row halts a run (S02)."""
    inner = lambda c: F.regexp_extract(F.regexp_replace(F.col(f"`{c}`"), f"^{_BLANK}+|{_BLANK}+$", ""), "([\\x00-\\x1f\\x7f-\\x9f])", 1)
    named = [c for c in raw.columns if c != order]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), inner(c).alias("x")) for c in named])
    long = raw.select(order, F.explode(rows).alias("f")).where("f.x <> ''")
    out = long.groupBy("f.column").agg(F.count("*").alias("n"), F.min_by("f.x", order).alias("x"))
    return out.select("column", "n", F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("x").cast("long")), 4, "0")).alias("first"))
