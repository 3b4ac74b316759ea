"""Claims held against an index: every reason code once, and none where nothing is wrong."""

from pyspark.sql import functions as F

from cohortlens.operators import claims

NUMBER = "attribute string, level string, op string, metric string, est double, ci_lo double, ci_hi double, reason string, suppressed boolean, status string, recomputed string"
CLAIM = "claim_id string, metric_id string, operating_point string, attribute string, level string, relation string, status string, value_refs array<string>"


def number(level, lo, hi, reason=None, suppressed=False, status=None, recomputed=None):
    return ("site", level, "op1", "sensitivity", 0.1, lo, hi, reason, suppressed, status, recomputed)


def test_each_reason_code(spark):
    gaps = spark.createDataFrame([number("a/b", 0.1, 0.2), number("c", -0.2, -0.1), number("d", -0.1, 0.1), number("e", None, None, "zero_denominator"), number("h", 0.1, 0.2, None, True)], NUMBER)
    criteria = spark.createDataFrame([number("m", 0.1, 0.2, None, False, "met", "met"), number("w", 0.1, 0.2, None, False, "met", "not_met")], NUMBER)
    found = claims.index(gaps, "gaps", True).unionByName(claims.index(criteria, "criteria", False))
    made = {x["level"]: x for x in claims.build(found).collect()}
    assert {k: x["relation"] for k, x in made.items()} == {"a/b": "above", "c": "below", "d": "within", "e": "not_assessable", "h": "not_assessable", "m": "estimate", "w": "estimate"}
    assert made["a/b"]["value_refs"] == ["/gaps/site/a~1b/op1/sensitivity"]
    ref = "/gaps/site/c/op1/sensitivity"
    good = {"metric_id": "sensitivity", "operating_point": "op1", "attribute": "site", "level": "c", "relation": "below", "status": None, "value_refs": [ref]}
    crit = {**good, "level": "m", "relation": "estimate", "status": "met", "value_refs": ["/criteria/site/m/op1/sensitivity"]}
    cases = [
        (None, good), ("claim_id_invalid", {**good, "claim_id": "7"}), ("claim_id_invalid", {**good, "claim_id": None}), ("value_refs_invalid", {**good, "value_refs": None}), ("relation_unknown", {**good, "relation": "near"}), ("relation_unknown", {**good, "relation": None}),
        ("status_not_in_enum", {**good, "status": "Met"}), ("value_refs_count", {**good, "value_refs": []}), ("value_ref_duplicate", {**good, "value_refs": [ref, ref]}), ("value_ref_unresolved", {**good, "value_refs": [ref, "/gaps/none"]}), ("value_ref_unresolved", {**good, "value_refs": [None]}),
        ("value_ref_suppressed", {**good, "level": "h", "value_refs": ["/gaps/site/h/op1/sensitivity"]}), ("metric_mismatch", {**good, "metric_id": None}), ("operating_point_mismatch", {**good, "operating_point": "op2"}), ("relation_mismatch", {**good, "relation": "above"}),
        ("subgroup_mismatch", {**good, "level": "d"}), ("subgroup_mismatch", {**good, "attribute": None}), ("status_on_non_criterion", {**good, "status": "met"}), (None, crit), ("relation_mismatch", {**crit, "status": "not_met", "relation": "within"}), ("status_mismatch", {**crit, "status": "not_met"}), ("status_mismatch", {**crit, "status": None}),
        ("status_recomputation_mismatch", {**crit, "level": "w", "value_refs": ["/criteria/site/w/op1/sensitivity"]}), ("claim_id_duplicate", {**good, "claim_id": "CL-9999"}), ("claim_id_duplicate", {**good, "claim_id": "CL-9999"}),
    ]
    names = [c.split()[0] for c in CLAIM.split(", ")]
    rows = [tuple({"claim_id": f"CL-{k:04d}", **x}[n] for n in names) for k, (_, x) in enumerate(cases)]
    got = sorted(map(str, ((x["claim_id"], x["reason_code"], x["accepted"]) for x in claims.check(spark.createDataFrame(rows, CLAIM), found).collect())))
    assert got == sorted(str((row[0], code, code is None)) for row, (code, _) in zip(rows, cases, strict=True))
    assert {code for code, _ in cases} - {None} == set(claims.REASONS)
    verdicts = claims.check(claims.build(found), found)
    assert {x["reason_code"] for x in verdicts.where(~F.col("accepted")).collect()} == {"value_ref_suppressed", "status_recomputation_mismatch"}
    assert claims.check(spark.createDataFrame([], CLAIM), found).count() == 0


def test_numbers_leave_only_with_enough_behind_them(spark):
    from cohortlens.operators import criteria

    rows = [("areas", "a", level, None, "auroc", n, e, x, 0.5, 0.4, 0.6, "why") for level, n, e, x in (("ok", 10, 5, 5), ("n", 9, 5, 4), ("events", 10, 4, 6), ("nonevents", 10, 6, 4), ("unknown", 10, None, 5))]
    df = spark.createDataFrame(rows, "block string, attribute string, level string, op string, metric string, n long, events long, nonevents long, est double, ci_lo double, ci_hi double, reason string")
    got = {x["level"]: (x["suppressed"], x["n"], x["est"], x["reason"]) for x in criteria.egress(df).collect()}
    assert got == {"ok": (False, 10, 0.5, "why"), **{k: (True, None, None, None) for k in ("n", "events", "nonevents", "unknown")}}
    assert {x["suppressed"] for x in criteria.egress(df, (11, 5, 5)).collect()} == {True} and "events" not in criteria.egress(df).columns
