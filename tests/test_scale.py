"""Bounded tasks: what grows with the input is the number of parts, not what one of them holds."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import counts, resample
from cohortlens.plans import cohorts, queries
from cohortlens.plans import declared as _declared  # noqa: F401 (registers its queries)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture
def many(monkeypatch):
    """Treats the line items as too many for the parts they are read in."""
    monkeypatch.setattr(cohorts, "FEW", 1000)
    monkeypatch.setattr(cohorts, "PART", 500)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_by(df):
    """What is shuffled by, of a plan."""
    return re.findall(r"hashpartitioning\((.*)\), ", plan(df))


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def test_line_items_are_dealt_by_order_into_bounded_parts(spark, many):
    items = cohorts.table(spark, SF, "lineitem").count()
    d = cohorts.shipments(spark, SF)
    sizes = d.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == cohorts.parts(cohorts.table(spark, SF, "lineitem")) == -(-items // 500) and max(sizes) < 1000 and sum(sizes) == items


def test_few_line_items_stay_as_they_are_read(spark):
    assert cohorts.parts(cohorts.table(spark, SF, "lineitem")) is None


@pytest.mark.parametrize("name", ["clustered_intervals", "clustered_subgroups", "clustered_overall_block"])
def test_units_of_levels_are_counted_by_kind_where_their_cases_are(spark, monkeypatch, name):
    few = sorted_rows(queries.QUERIES[name](spark, SF))
    monkeypatch.setattr(cohorts, "FEW", 1000)
    monkeypatch.setattr(cohorts, "PART", 500)
    got = queries.QUERIES[name](spark, SF)
    assert not [x for x in shuffled_by(got) if "case_id" in x]  # of cases, only kinds leave a part
    assert sorted_rows(got) == few


def by_case(spark, monkeypatch, name):
    few = sorted_rows(queries.QUERIES[name](spark, SF))
    monkeypatch.setattr(cohorts, "FEW", 1000)
    monkeypatch.setattr(cohorts, "PART", 500)
    got = queries.QUERIES[name](spark, SF)
    assert "Union" not in plan(got) or name == "bootstrap_clustered_differences"  # one pass for both classes of rows
    assert not [x for x in shuffled_by(got) if "case_id" in x]
    assert sorted_rows(got) == few


def test_design_effects_stay_in_parts(spark, monkeypatch):
    by_case(spark, monkeypatch, "design_effects")


def test_drawn_proportions_stay_in_parts(spark, monkeypatch):
    by_case(spark, monkeypatch, "bootstrap_clustered_proportions")


def test_drawn_differences_stay_in_parts(spark, monkeypatch):
    by_case(spark, monkeypatch, "bootstrap_clustered_differences")


def test_gates_deal_cases_and_row_ids_into_parts(spark, monkeypatch):
    few = sorted_rows(queries.QUERIES["gate_report"](spark, SF))
    monkeypatch.setattr(cohorts, "FEW", 1000)
    monkeypatch.setattr(cohorts, "PART", 500)
    got = queries.QUERIES["gate_report"](spark, SF)
    assert not [x for x in shuffled_by(got) if "case_id" in x]
    assert re.findall(r"hashpartitioning\(row_id#\d+, (\d+)\)", plan(got)) == ["12"]
    assert sorted_rows(got) == few


def test_cases_with_the_same_rows_are_one_kind(spark):
    rows = [(i, "a", y, s, p) for i in range(3000) for y, s, p in ((1, 0.25 + i % 2 / 4, 0.5), (0, 0.4, None if i % 4 < 2 else 0.5))]
    df = spark.createDataFrame(rows, "case long, k string, y int, score double, prior double")
    one = resample.case_kinds(df, "case", ["k"], ["score"], 7).collect()
    assert sorted((r["c"], r["y"], r["score"], r["n"]) for r in one) == [(1500, 0, 0.4, 1), (1500, 0, 0.4, 1), (1500, 1, 0.25, 1), (1500, 1, 0.5, 1)]
    both = resample.case_kinds(df, "case", ["k"], ["score", "prior"], 7).collect()
    assert {r["c"] for r in both} == {750} and len({r["h"] for r in both}) == 4


def test_kinds_are_weighted_as_the_sum_of_their_cases():
    h = np.random.default_rng(1).integers(-(2**62), 2**62, 3000)
    for c in (1, 2, 30, 5000):
        w = resample.kind_weights(h, np.full(3000, c), 100, 100)
        assert abs(w.mean() - c) < 5 * (c / w.size) ** 0.5 and abs(w.var() / c - 1) < 0.02 and abs(np.corrcoef(w.T)[0, 1:]).max() < 0.1
    exact = resample.exact_weights(3, ("k",), 40, 50)
    assert exact.shape == (41, 50) and (exact[0] == 0).all() and (exact[-1] == 40).all()


def test_areas_of_kinds_vary_as_those_of_cases(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, "a", int(y), float(s)) for i in range(2500) for y, s in zip(rng.integers(0, 2, 2), rng.integers(1, 4, 2) / 4, strict=True)]
    df = spark.createDataFrame(rows, "case long, k string, y int, score double")
    assert resample.case_kinds(df, "case", ["k"], ["score"], 1).select("h").distinct().count() < 30
    spread = lambda: np.std([r["value"] for r in resample.clustered_areas(df, "case", ["k"], 2000).collect()])
    kinds = spread()
    plain = resample.case_kinds
    monkeypatch.setattr(resample, "case_kinds", lambda d, case, keys, scores, seed: plain(d.withColumn("_own", F.col(case)), case, [*keys, "_own"], scores, seed).drop("_own"))
    assert kinds == pytest.approx(spread(), rel=0.08)  # 2,000 draws each: about 2 % of error


def test_cases_of_levels_are_told_where_they_are(spark, many):
    long = counts.unfold(cohorts.analysed(spark, SF), cohorts.ATTRIBUTES, ["case_id", "y", "score"])
    kinds = resample.case_kinds(long, "case_id", ["attribute", "level"], ["score"], 1)
    assert not [x for x in shuffled_by(kinds) if "case_id" in x]


def test_area_differences_leave_no_part_by_case(spark, many):
    got = queries.QUERIES["bootstrap_clustered_area_differences"](spark, SF)
    assert not [x for x in shuffled_by(got) if "case_id" in x]


def test_both_scores_of_a_pair_share_their_kinds(spark):
    rows = [(i, "a", y, 0.25 + i % 2 / 2, 0.5) for i in range(1200) for y in (0, 1)]
    df = spark.createDataFrame(rows, "case long, k string, y int, score double, prior double")
    kinds = resample.case_kinds(df, "case", ["k"], ["score", "prior"], 7)
    new, prior = ({(r["h"], r["c"]) for r in kinds.where(f"{s} is not null").collect()} for s in ("score", "prior"))
    assert new == prior and sorted(c for _, c in new) == [600, 600]  # though all priors are equal


def test_pairs_are_won_alike_however_many_rows_are_taken_at_a_time():
    rng = np.random.default_rng(3)
    s = np.sort(rng.integers(0, 25, 300)) / 25
    p, q, mixed, weight = rng.integers(0, 3, 300), rng.integers(0, 2, 300), rng.random(300) < 0.5, rng.integers(0, 4, (300, 5)).astype(float)
    wins = (s[:, None] > s) + (s[:, None] == s) / 2
    side = lambda x, k: weight * (x * (mixed == k))[:, None]
    plain = [np.einsum("rb,rt,tb->b", side(p, i), wins, side(q, j)) for i in (False, True) for j in (False, True)]
    for rows in (1, 7, 64, 4096):
        pairs = resample.Pairs(s, p, q, mixed, 5)
        for lo in range(0, 300, rows):
            pairs.turn(slice(lo, lo + rows))
            pairs.add(weight[lo : lo + rows], slice(0, 5))
        assert (pairs.won == plain).all()


def test_weights_looked_up_by_first_bits_are_those_searched_for(monkeypatch):
    h = np.random.default_rng(4).integers(-(2**62), 2**62, 3000)
    c = np.resize([1, 2, 60, 4000], 3000)
    found = resample.kind_weights(h, c, 100, 100)
    monkeypatch.setattr(resample, "GUIDED", 10**9)
    assert (found == resample.kind_weights(h, c, 100, 100)).all()


def test_kinds_of_both_scores_are_made_once(spark):
    got = queries.QUERIES["bootstrap_clustered_paired"](spark, SF)
    assert plan(got).count("events.parquet") == 1  # for the classes' strata; kinds are read back


def test_area_differences_read_line_items_once_for_kinds_and_once_for_cases(spark, monkeypatch):
    kept = []
    keep = resample._kept
    monkeypatch.setattr(resample, "_kept", lambda df: kept.append(plan(df).count("lineitem.parquet")) or keep(df))
    got = queries.QUERIES["bootstrap_clustered_area_differences"](spark, SF)
    assert kept == [1, 1] and "lineitem.parquet" not in plan(got)
