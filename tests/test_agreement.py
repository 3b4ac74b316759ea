"""Agreement and drift against plain Python, at ties, empty cells and far from zero."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import agreement


def test_moments_far_from_zero(spark):
    r = random.Random(1)
    pairs = [(1e9 + r.random(), 1e9 + r.random()) for _ in range(400)]
    got = agreement.paired_moments(spark.createDataFrame([("k", *p) for p in pairs] + [("one", 1.0, 2.0), ("none", None, 1.0)], "k string, a double, b double").repartition(7), ["k"], "a", "b")
    got = {x["k"]: x for x in got.collect()}
    d = [a - b for a, b in pairs]
    sd = statistics.stdev(d)
    a, b = ([p[k] - 1e9 for p in pairs] for k in (0, 1))
    cov = statistics.covariance(a, b) * 399 / 400
    ccc = 2 * cov / (statistics.pvariance(a) + statistics.pvariance(b) + statistics.mean(d) ** 2)
    want = {"bias": statistics.mean(d), "loa_low": statistics.mean(d) - 1.96 * sd, "loa_high": statistics.mean(d) + 1.96 * sd, "mae": statistics.mean(map(abs, d)), "rmse": math.sqrt(statistics.mean(x * x for x in d)), "ccc": ccc}
    assert {k: got["k"][k] for k in want} == pytest.approx(want, rel=1e-5, abs=1e-7)
    assert (got["one"]["n"], got["one"]["loa_low"], got["one"]["rmse"]) == (1, None, 1.0) and "none" not in got


def test_average_precision_with_ties_and_one_class(spark):
    rows = [("a", s, y) for s, y in ((0.9, 1), (0.8, 0), (0.8, 1), (0.8, 1), (0.1, 0), (0.1, 1), (None, 1))] + [("b", 0.5, 1)]
    got = {x["k"]: x for x in agreement.auprc(spark.createDataFrame(rows, "k string, score double, y int"), ["k"]).collect()}
    assert got["a"]["auprc"] == pytest.approx((1 * 1 + 2 * 3 / 4 + 1 * 4 / 6) / 4) and (got["b"]["auprc"], got["b"]["reason"]) == (None, "single_class")


def test_drift_equals_plain_functions(spark):
    r = random.Random(2)
    rows = [(c, r.choice([None, round(r.gauss(m, 0.2), 2)]), r.choice(levels)) for c, m, levels in (("p0", 0.4, "aab"), ("p1", 0.5, "abc"), ("p2", 2.5, "d")) for _ in range(120)] + [("p3", 0.4, None), (None, 0.1, "a")]
    df = spark.createDataFrame(rows, "period string, score double, site string")
    scores = {c: [s for p, s, _ in rows if p == c and s is not None] for c in ("p0", "p1", "p2", "p3")}
    at = sorted({s for v in scores.values() for s in v})
    share = lambda v, s: sum(x <= s for x in v) / len(v)
    got = {x["cohort"]: x["ks_d"] for x in agreement.ks_drift(df, "period", "p0").collect()}
    assert got == pytest.approx({c: max(abs(share(scores[c], s) - share(scores["p0"], s)) for s in at) for c in ("p1", "p2", "p3")})
    levels = {c: [x or "Unknown/missing" for p, _, x in rows if p == c] for c in scores}
    bins = {x for v in levels.values() for x in v}
    part = lambda c: {b: max(levels[c].count(b) / len(levels[c]), 1e-4) for b in bins if levels[c].count(b) or levels["p0"].count(b)}
    want = {c: sum((a - b) * math.log(a / b) for k, a in part(c).items() for b in [max(levels["p0"].count(k) / len(levels["p0"]), 1e-4)]) for c in ("p1", "p2", "p3")}
    assert {x["cohort"]: x["psi"] for x in agreement.attribute_drift(df, "period", "p0", ["site"]).collect()} == pytest.approx(want)


def test_kappa_of_perfect_chance_and_one_category(spark):
    rows = [("same", i % 3, i % 3) for i in range(9)] + [("cross", i, j) for i in range(3) for j in range(3)] + [("flat", 1, 1), ("flat", None, 1)]
    got = {x["k"]: x for x in agreement.kappa(spark.createDataFrame(rows, "k string, i int, j int"), ["k"], F.col("i"), F.col("j"), 3).collect()}
    assert (got["same"]["kappa"], got["same"]["kappa_weighted"]) == (1, 1)
    assert (got["cross"]["kappa"], got["cross"]["kappa_weighted"]) == pytest.approx((0, 0)) and (got["flat"]["n"], got["flat"]["kappa"]) == (1, None)


def test_similarity_of_equal_and_of_disjoint_sides(spark):
    rows = [(s, "x" if k % 2 else "y", "u" if s else "v") for s in (True, False) for k in range(20)]
    got = {x["attribute"]: x for x in agreement.similarity(spark.createDataFrame(rows, "side boolean, a string, b string"), "side", ["a", "b"]).collect()}
    assert (got["a"]["cramers_v"], got["a"]["smd_max"]) == (0, 0) and got["b"]["cramers_v"] == pytest.approx(1) and got["b"]["smd_max"] is None


def test_areas_take_the_interval_of_their_route(spark):
    from cohortlens.operators import declared, ranks, resample

    r = random.Random(4)
    rows = [(c, r.random(), int(r.random() < 0.4), "big" if c % 9 else "small", None if c % 50 == 0 else "x") for c in range(100) for _ in range(2)]
    df = spark.createDataFrame(rows, "case long, score double, y int, site string, ward string")
    at = ["attribute", "level"]
    from cohortlens.operators.counts import unfold

    long = unfold(df, ["site", "ward"], ["y", "score", "case"])
    areas = ranks.auroc(long, at)
    plain = {(x["attribute"], x["level"]): x for x in ranks.auroc_interval(areas).collect()}
    got = {(x["attribute"], x["level"]): x for x in declared.routed_areas(df, areas, ["site", "ward"], None, 200, 7).collect()}
    assert {k: x["route"] for k, x in got.items()} == {k: "row_bootstrap" if min(x["n_pos"], x["n_neg"]) < 10 else "delong" for k, x in plain.items()} and len({x["route"] for x in got.values()}) == 2
    drawn = {(x["attribute"], x["level"]): x for x in resample.bootstrap_auroc(long, at, 200, 7).collect()}
    for k, x in got.items():
        assert (x["ci_lo"], x["ci_hi"]) == pytest.approx((lambda y: (y["ci_lo"], y["ci_hi"]))(plain[k] if x["route"] == "delong" else drawn[k]))
    whole = {(x["attribute"], x["level"]): x for x in declared.routed_areas(df, areas, ["site", "ward"], "case", 200, 7).collect()}
    cases = {(x["attribute"], x["level"]): x for x in resample.bootstrap_clustered_auroc(long, "case", at, 200, 7).collect()}
    assert {x["route"] for x in whole.values()} == {"cluster_bootstrap"} and whole.keys() == plain.keys()
    assert all((x["ci_lo"], x["ci_hi"], x["reason"]) == (cases[k]["ci_lo"], cases[k]["ci_hi"], cases[k]["reason"]) or x["reason"] == "single_class" for k, x in whole.items())
    assert whole["overall", "all"]["ci_lo"] < whole["overall", "all"]["auc"] < whole["overall", "all"]["ci_hi"]


def test_equal_mass_bins_rank_ties_by_text_ids(spark):
    from pyspark.sql import Window

    from cohortlens.operators import calibration

    r = random.Random(6)
    ids = r.sample(range(10_000), 157)
    rows = [(f"{i}-{i % 3}" if i % 5 else f"é{i}", r.choice([0.2, 0.2, 0.5, 0.7]), int(i % 2)) for i in ids]
    df = spark.createDataFrame(rows, "row_id string, score double, y int")
    want = {x["row_id"]: x["bin"] - 1 for x in df.withColumn("bin", F.ntile(10).over(Window.orderBy("score", "row_id"))).collect()}
    assert {x["row_id"]: x["bin"] for x in calibration.mass_bins(df, "score", "row_id").collect()} == want
