"""An analysis's declarations: YAML read once on the driver, and what they refer to held against the levels that Spark finds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.counts import OVERALL, UNKNOWN, OperatingPoint
from cohortlens.sources.ingest import InputError

#: Declarations that must be there, and metrics by what they need (fixed values).
REQUIRED = ("schema_version", "model", "task", "classes", "score", "operating_points", "reference_standard", "indeterminates", "clustering", "prevalence", "subgroups")
AT_A_POINT = ("sensitivity", "specificity", "ppa", "npa", "ppv", "npv", "accuracy", "balanced_accuracy", "f1", "mcc", "lr_pos", "lr_neg", "dor", "youden", "tpr_gap", "fpr_gap", "ppv_gap", "npv_gap")
WITHOUT_POINT = ("auroc", "auroc_gap", "brier", "ipa", "oe", "calibration_slope", "calibration_intercept", "prevalence")
NOT_COMPUTED = ("ece", "auprc", "psi", "ks_d", "kappa", "macro_auroc", "bias", "loa_low", "loa_high", "mae", "rmse", "ccc", "dice_mean", "dice_median")
RULES = (">=", ">", "<=", "<")


@dataclass(frozen=True)
class Declarations:
    model: str
    version: str
    positive: str
    negative: str
    probability: bool
    higher_is_positive: bool
    points: tuple[OperatingPoint, ...]
    indeterminate: tuple[str, ...] = ()
    clustered: bool = False
    prevalence: tuple[tuple[str, float], ...] = ()
    references: dict[str, str | None] = field(default_factory=dict)
    bands: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    criteria: tuple[dict, ...] = ()
    fairness: dict | None = None
    period: tuple[str, str] | None = None
    resamples: int = 2000
    seed: int = 20240101
    suppression: tuple[int, int, int] = (10, 5, 5)
    predicted_point: str | None = None
    attributes: tuple[str, ...] = ()

    def point(self, name: str) -> OperatingPoint:
        return next(p for p in self.points if p.id == name)


def _filled(x: object) -> bool:
    return x not in (None, "", "null", "~")


def parse(text: str) -> Declarations:
    """Declarations of a YAML text.  Scalars stay as written, so a version 2.10 and a date keep their digits.

    InputError lists everything that is wrong at once.  H08: something required is missing or contradicts
    itself; H09: a metric or operating point that is not known; E01: clusters by another unit than a case.
    """
    d = yaml.load(text, Loader=yaml.BaseLoader)  # noqa: S506 (strings, lists and mappings only)
    lacking = [k for k in REQUIRED if k not in d] if isinstance(d, dict) else ["everything"]
    if lacking:
        raise InputError(f"H08: {', '.join(lacking)} not declared")
    try:
        out = Declarations(**_model(d), **_groups(d), **_limits(d))
    except (KeyError, TypeError, ValueError) as e:
        raise InputError(f"H08: a declaration is missing or has another type ({type(e).__name__})") from e
    found = sorted({*_model_problems(out, d), *_group_problems(out), *(p for c in out.criteria for p in _criterion_problems(out, c))})
    if found:
        raise InputError("; ".join(f"{code}: {what}" for code, what in found))
    return out


def _model(d: dict) -> dict:
    return {
        "model": d["model"]["name"], "version": d["model"]["version"], "positive": d["classes"]["positive"], "negative": d["classes"]["negative"],
        "probability": d["score"]["type"] == "probability", "higher_is_positive": d["score"]["orientation"] == "higher_is_positive",
        "points": tuple(OperatingPoint(p["id"], p["rule"], float(p["threshold"])) for p in d["operating_points"]), "predicted_point": d.get("y_pred_operating_point"),
        "indeterminate": tuple(d["indeterminates"].get("values") or ()), "clustered": d["clustering"]["unit"] == "case_id",
    }


def _groups(d: dict) -> dict:
    named = lambda s: s["reference_level"] if _filled(s.get("reference_level")) and s["reference_level"] != "largest" else None
    return {
        "references": {s["attribute"]: named(s) for s in d["subgroups"]}, "attributes": tuple(s["attribute"] for s in d["subgroups"]),
        "bands": {s["attribute"]: [(float(a), float(b)) for a, b in s["bands"]] for s in d["subgroups"] if s.get("bands")},
        "criteria": tuple(d.get("criteria") or ()), "fairness": d["fairness"] if _filled(d.get("fairness")) else None,
        "prevalence": tuple((p["label"], float(p["value"])) for p in d["prevalence"]),
    }


def _limits(d: dict) -> dict:
    least, draws = d.get("egress", {}).get("suppression", {}), d.get("bootstrap", {})
    return {
        "suppression": tuple(max(int(least.get(k, low)), low) for k, low in (("min_n", 10), ("min_events", 5), ("min_nonevents", 5))),
        "resamples": int(draws.get("B", 2000)), "seed": int(draws.get("seed", 20240101)),
        "period": (d["period"]["column"], d["period"]["granularity"]) if _filled(d.get("period")) else None,
    }


Problem = tuple[str, str]


def _model_problems(d: Declarations, raw: dict) -> Iterator[Problem]:
    if d.positive == d.negative:
        yield "H08", "the two classes are identical"
    if raw["clustering"]["unit"] not in ("case_id", "none", "null", ""):
        yield "E01", "cases are the only unit of clusters"
    if any(n > 1 for n in Counter(p.id for p in d.points).values()):
        yield "H08", "operating points share an id"
    if OVERALL[0] in {p.id for p in d.points} or "*" in {p.id for p in d.points}:
        yield "H08", "an operating point has a reserved id"
    if any(p.rule not in RULES for p in d.points):
        yield "H08", "an operating point has none of the four rules"
    if d.predicted_point is not None and d.predicted_point not in {p.id for p in d.points}:
        yield "H09", "y_pred belongs to an operating point that is not declared"


def _group_problems(d: Declarations) -> Iterator[Problem]:
    if any(n > 1 for n in Counter(d.attributes).values()):
        yield "H08", "an attribute is declared twice"
    if OVERALL[0] in d.attributes:
        yield "H08", "an attribute has a reserved name"
    if UNKNOWN in d.references.values():
        yield "H09", "missing values cannot be the reference level"
    if any(not low < high for bands in d.bands.values() for low, high in bands):
        yield "H08", "a band is empty"


def _criterion_problems(d: Declarations, c: dict) -> Iterator[Problem]:
    name, point = c.get("id", "?"), c.get("operating_point")
    if not all(_filled(c.get(k)) for k in ("id", "author", "date", "justification")):
        yield "H08", f"criterion {name} lacks its id, author, date or justification"
    needs = {m: kind for kind, metrics in (("point", AT_A_POINT), ("none", WITHOUT_POINT), ("open", NOT_COMPUTED)) for m in metrics}.get(c.get("metric"))
    if needs is None:
        yield "H09", f"criterion {name} names an unknown metric"
    if needs == "point" and point not in {p.id for p in d.points}:
        yield "H09", f"criterion {name} needs a declared operating point"
    if needs == "none" and point is not None:
        yield "H09", f"criterion {name} has an operating point that its metric does not take"


def mentions(d: Declarations) -> list[tuple[str, str, str | None]]:
    """(owner, attribute, level or None) of all that the declarations say about the table's attributes."""
    out = [("subgroup " + a, a, None) for a in d.attributes] + [("subgroup " + a, a, r) for a, r in d.references.items() if r is not None]
    scoped = [("criterion " + c["id"], c["scope"]) for c in d.criteria if isinstance(c.get("scope"), dict)]
    if d.fairness is not None:
        scoped.append(("fairness", {"attribute": d.fairness["attribute"], "level": d.fairness.get("reference_level") or "*"}))
    for owner, scope in scoped:
        level = scope["level"] if scope["level"] not in ("*", "largest") else None
        out += [(owner, scope["attribute"], None), (owner, scope["attribute"], level)]
    return out


def unmet(d: Declarations, levels: DataFrame) -> DataFrame:
    """owner, attribute, level of what is declared and not in (attribute, level) of the table, as an anti-join.

    A null level stands for the attribute itself.
    """
    spark = levels.sparkSession
    said = spark.createDataFrame(mentions(d) or [("", "", "")], "owner string, attribute string, level string").distinct()
    there = levels.select("attribute", "level").unionByName(levels.select("attribute", F.lit(None).cast("string").alias("level"))).distinct()
    there = there.select(F.col("attribute").alias("a"), F.col("level").alias("l"))
    return said.where("owner <> ''").join(there, (F.col("attribute") == F.col("a")) & F.col("level").eqNullSafe(F.col("l")), "left_anti")


def check_levels(d: Declarations, levels: DataFrame, numeric_age: bool = False) -> None:
    """H09 with all owners whose attribute or level the table lacks; H08 for a numeric age without bands.

    levels: (attribute, level) in use, as of ``counts.table_one``; a numeric age counts as there, with its bands
    as levels.
    """
    if numeric_age:
        names = [f"{lo:g}-{hi:g}" for lo, hi in d.bands.get("age", [])]
        ages = levels.sparkSession.createDataFrame([("age", x) for x in (*names, UNKNOWN)], "attribute string, level string")
        if "age" in d.attributes and not names and levels.where("attribute = 'age'").isEmpty():
            raise InputError("H08: a numeric age needs bands")
        levels = levels.select("attribute", "level").unionByName(ages)
    owners = sorted({r["owner"] for r in unmet(d, levels).collect()})  # at most a row a declaration
    if owners:
        raise InputError(f"H09: not in the table, for {', '.join(owners)}")
