"""Analyses driven by declarations: orientation, points, references, checks, criteria, and draws on exact scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import compare, counts, criteria, declared, ranks, resample
from cohortlens.sources import ingest
from cohortlens.sources.declare import Declarations
from cohortlens.sources.ingest import InputError

POINT = counts.OperatingPoint("op1", ">=", 0.5)


def model(**other):
    return Declarations(**{"model": "m", "version": "1", "positive": "1", "negative": "0", "probability": True, "higher_is_positive": True, "points": (POINT,), **other})


def test_orientation_mirrors_the_area(spark):
    rows = spark.createDataFrame([("g", i % 2, (i % 7) / 10) for i in range(40)], "g string, y int, score double")
    up, down = (declared.oriented(rows, model(higher_is_positive=x)) for x in (True, False))
    a, b = (ranks.auroc(x, ["g"], "rank_score").first()["auc"] for x in (up, down))
    assert a == pytest.approx(1 - b) and down.where("probability is not null").count() == 0 and up.where("probability = score").count() == 40


def test_predictions_stand_for_one_point(spark):
    with pytest.raises(InputError, match="H08"):
        declared.points_of(model(points=(POINT, counts.OperatingPoint("op2", ">", 0.7))), scored=False)
    rows = spark.createDataFrame([(1, "1", None), (0, "1", None), (0, "0", None)], "y int, y_pred string, score double")
    got = counts.two_by_two(rows, [], declared.points_of(model(), scored=False)).first()
    assert (got["op"], got["tp"], got["fp"], got["tn"]) == ("op1", 1, 1, 1)


def test_declared_reference_must_have_rows(spark):
    sizes = spark.createDataFrame([("sex", "F", 3), ("sex", "M", 9), ("site", "a", 1), ("site", counts.UNKNOWN, 5)], "attribute string, level string, n long")
    got = {r["attribute"]: r["reference"] for r in declared.reference_levels(sizes, model(references={"sex": "F", "site": None})).collect()}
    assert got == {"sex": "F", "site": "a"}
    with pytest.raises(InputError, match="H09.*sex"):
        declared.reference_levels(sizes, model(references={"sex": "X"}))
    order = {(r["attribute"], r["level"]): r["position"] for r in declared.level_order(sizes).collect()}
    assert order == {("sex", "F"): 1, ("sex", "M"): 2, ("site", "a"): 1, ("site", counts.UNKNOWN): 2}


def test_input_checks(spark):
    raw = spark.createDataFrame([("a\x01", "inf", None, "train"), ("b", "1e999", "c1", None), ("b", None, "c1", "dev")], "attr string, score string, case_id string, dataset string")
    got = [(r["code"], r["role"], r["n"], r["halts"]) for r in declared.input_checks(raw, "period").orderBy("step").collect()]
    assert got == [("S01", "y_true", 1, True), ("S01", "score", 0, False), ("S02", "any", 1, True), ("S02", "score", 2, True), ("S05", "case_id", 1, True), ("S03", "period", 1, True), ("S02", "dataset", 1, True)]
    bare = spark.createDataFrame([("1",)], "y_true string").where("false")
    assert [(r["code"], r["n"]) for r in declared.input_checks(bare).where("halts").collect()] == [("S01", 1)]


def test_limits_can_only_rise(spark):
    cells = spark.createDataFrame([(12, 6), (60, 30)], "n long, k long")
    hide = lambda least: [r["h"] for r in cells.select(criteria.suppressed(F.col("n"), F.col("k"), F.col("n") - F.col("k"), least).alias("h")).collect()]
    assert hide((1, 1, 1)) == [False, False] and hide((20, 5, 5)) == [True, False] and hide((10, 40, 5)) == [True, True]


def test_names_beyond_two_letters(spark):
    ranks_ = [1, 26, 27, 52, 53, 702, 703, 728, 729, 18278, 18279]
    got = [r["x"] for r in spark.createDataFrame([(i,) for i in ranks_], "r long").orderBy("r").select(criteria.letters(F.col("r")).alias("x")).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAZ", "ABA", "ZZZ", "AAAA"]


def test_first_rows_count(spark):
    new = spark.createDataFrame([("a", 1), ("b", 0)], "id string, y int")
    prior = spark.createDataFrame([("a", 1, 1), ("a", 0, 2), ("b", 1, 3)], "id string, y int, at int")
    got = compare.join_counts(new, prior, "id", "at").first()
    assert (got["pairs"], got["label_mismatch"]) == (1, 1)
    seen = {r["c"]: r["place"] for r in declared.first_appearance(spark.createDataFrame([("z", 1), ("a", 2), ("z", 3), (None, 4)], "c string, i long"), "c", "i").collect()}
    assert seen == {"z": 0, "a": 1}


def test_every_criterion_has_a_reason(spark):
    schema = "quantity string, attribute string, level string, op string, metric string, n long, est double, ci_lo double, ci_hi double, suppressed boolean"
    rows = [("value", "overall", "all", "op1", "ppv", 50, 0.8, 0.7, 0.9, False), ("value", "sex", "F", "op1", "ppv", 9, 0.8, None, None, True), ("value", "sex", "M", "op1", "ppv", 40, 0.8, 0.6, 0.9, False), ("value", "sex", counts.UNKNOWN, "op1", "ppv", 4, 0.8, 0.6, 0.9, False), ("value", "overall", "all", None, "brier", None, 0.1, None, None, False)]
    cells = spark.createDataFrame(rows, schema)
    asked = [("a", "value", "sex", "*", "op1", "ppv", "ci_lower_bound", ">", 0.6), ("b", "value", "overall", "all", None, "brier", "estimate", "<", 1.0), ("c", "value", "sex", "M", None, "brier", "estimate", "<", 1.0), ("d", "value", "age", "*", "op1", "ppv", "estimate", ">", 0.0), ("e", "paired_difference_vs_prior", "overall", "all", "op1", "ppv", "estimate", ">", 0.0), ("f", "value", "sex", "F", "op1", "tpr_gap", "estimate", ">", 0.0), ("g", "value", "overall", "all", "op1", "ppv", "estimate", "<=", 0.8)]
    criteria_ = spark.createDataFrame(asked, "id string, quantity string, attribute string, level string, op string, metric string, statistic string, comparator string, value double")
    got = sorted((r["id"], r["level"], r["status"], r["reason"]) for r in declared.evaluate(criteria_, cells, spark.createDataFrame([("sex", "F")], "attribute string, reference string")).collect())
    assert got == [
        ("a", "F", "not_assessable", "suppressed"), ("a", "M", "not_met", "statistic_compared"), ("b", "all", "not_assessable", "no_interval"), ("c", "M", "not_assessable", "metric_not_computed_for_scope"),
        ("d", "*", "not_assessable", "level_absent"), ("e", "all", "not_assessable", "requires_compare"), ("f", "F", "not_assessable", "level_is_reference"), ("g", "all", "met", "statistic_compared"),
    ]


def test_summaries_hide_what_is_rare(spark):
    rows = [("yes", f"note {i}", "2024-01-02", None) for i in range(12)] + [("no", f"note {i}", "2024-03-04", "") for i in range(20, 23)]
    got = {r["column"]: r for r in ingest.summaries(spark.createDataFrame(rows, "flag string, note string, day string, blank string"), ["flag", "note", "day", "blank"]).collect()}
    assert {c: r["type"] for c, r in got.items()} == {"flag": "categorical", "note": "string", "day": "date", "blank": "empty"}
    assert (got["flag"]["split"], got["flag"]["n_suppressed_values"]) == ("yes:12,<suppressed>:1", 1)
    assert (got["note"]["free_text"], got["note"]["values_shown"], got["note"]["split"], got["day"]["values_shown"], got["day"]["split"]) == (True, False, None, False, None)
    assert got["blank"]["missing_pct"] == 100
    assert ingest.summaries(spark.createDataFrame([], "a string"), ["a"]).count() == 0


def test_control_findings(spark):
    raw = spark.createDataFrame([(2, "a\x1fb", "x"), (1, "\x85a", "x"), (3, "b\x07", "x\x7fy")], "i long, a string, b string")
    got = {r["column"]: (r["n"], r["first"]) for r in ingest.control_findings(raw, "i").collect()}
    assert got == {"a": (2, "U+001F"), "b": (1, "U+007F")}  # a control character that is white space at an end is trimmed
    seen = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("c", 4)], "v string, i long")
    assert [r["value"] for r in ingest.top_values(seen, "v", least=1, order="i").orderBy("rank").collect()] == ["c", "b", "a"]


def test_only_declared_roles_are_read(spark):
    df = spark.createDataFrame([("1", "0.5", "x", "y", "z")], "y_true string, score string, attr_site string, rater_a string, other string")
    assert declared.pruned(df, {"y_true", "score", "case_id"}).columns == ["y_true", "score", "attr_site", "rater_a"]


def _plain_area(s, y):
    s, y = np.array(s), np.array(y)
    gap = np.sign(s[y == 1][:, None] - s[y == 0][None, :])
    return ((gap + 1) / 2).mean()


def test_tiny_scores_keep_their_order(spark):
    """Scores of a rare event model lie close to 0; draws rank them as they are."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 150)
    s = (rng.normal(0, 1, 150) + y) * 1e-7 + 1e-6
    df = spark.createDataFrame([("g", i // 2, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "g string, case long, y int, score double")
    draws = []
    for _ in range(1500):
        pick = np.concatenate([rng.choice(np.flatnonzero(y == k), (y == k).sum()) for k in (1, 0)])
        draws.append(_plain_area(s[pick], y[pick]))
    lo, hi = np.quantile(draws, [0.025, 0.975])
    row = resample.bootstrap_auroc(df, ["g"]).first()
    assert abs(row["ci_lo"] - lo) < 0.15 * (hi - lo) and abs(row["ci_hi"] - hi) < 0.15 * (hi - lo)
    clustered = resample.bootstrap_clustered_auroc(df, "case", ["g"]).first()
    assert clustered["ci_lo"] < _plain_area(s, y) < clustered["ci_hi"] and clustered["draws"] == 2000
    assert 0.5 * (hi - lo) < clustered["ci_hi"] - clustered["ci_lo"] < 2 * (hi - lo)


def test_row_draws_do_not_hang_on_partitions(spark):
    df = spark.range(300).selectExpr("'g' as g", "cast(id % 3 = 0 as int) as y", "(id * 37 % 101) / 101 as score", "(id * 11 % 97) / 97 as prior")
    for f in (resample.bootstrap_auroc, resample.bootstrap_brier, resample.bootstrap_paired_brier):
        one, other = (f(x, ["g"], b=150).first().asDict() for x in (df, df.repartition(7)))
        assert all(other[k] == (pytest.approx(v) if isinstance(v, float) else v) for k, v in one.items())
