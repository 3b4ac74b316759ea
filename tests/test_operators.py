"""Operators on published fixtures, edge cases and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import intervals as ci
from cohortlens.operators import calibration, compare, counts, criteria, gates, ranks, resample
from cohortlens.operators.counts import OperatingPoint
from cohortlens.sources import ingest
from cohortlens.streaming.windows import windowed_counts

Y = [1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
S1 = [0.9, 0.8, 0.7, 0.6, 0.35, 0.75, 0.5, 0.4, 0.3, 0.2]
S2 = [0.85, 0.6, 0.65, 0.4, 0.3, 0.7, 0.55, 0.45, 0.35, 0.25]
F4_Y = [0, 0, 0, 0, 1, 0, 0, 1, 1, 1, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1]
F4_P = [*[round(0.05 * i, 2) for i in range(1, 20)], 0.99]


def values(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lits(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize(("k", "n", "lo", "hi"), [(81, 263, 0.2552885198782742, 0.36620957698280004), (490, 500, 0.9635798167531208, 0.9891008164037892), (0, 20, 0, 0.1611251580528194), (20, 20, 0.8388748419471804, 1)])
def test_wilson(spark, k, n, lo, hi):
    assert tuple(values(spark, *ci.wilson(*lits(k, n)))) == pytest.approx((lo, hi), abs=1e-9)


@pytest.mark.parametrize(
    ("cells", "ten", "eleven"),
    [((56, 70, 48, 80), (0.0524, 0.3339), (0.0428, 0.3422)), ((9, 10, 3, 10), (0.1705, 0.8090), (0.1013, 0.8387)), ((10, 10, 0, 20), (0.6791, 1), (0.6014, 1))],
)
def test_newcombe(spark, cells, ten, eleven):
    assert tuple(values(spark, *ci.newcombe(*lits(*cells)))) == pytest.approx(ten, abs=6e-5)
    assert tuple(values(spark, *ci.newcombe(*lits(*cells), continuity=True))) == pytest.approx(eleven, abs=6e-5)


@pytest.mark.parametrize(("cells", "want"), [((36, 12, 2, 0), (0.0569, 0.3404)), ((20, 12, 2, 16), (0.0562, 0.3292)), ((18, 12, 2, 18), (0.0562, 0.3290)), ((80, 2, 10, 8), (-0.1554, -0.0102))])
def test_newcombe_paired(spark, cells, want):
    assert tuple(values(spark, *ci.newcombe_paired(*lits(*cells)))) == pytest.approx(want, abs=6e-5)


def test_two_by_two_metrics(spark):
    c = spark.createDataFrame([("overall", "all", "op1", 90, 10, 20, 180)], "attribute string, level string, op string, tp long, fn long, fp long, tn long")
    m = {r["metric"]: r for r in counts.metric_family(c).collect()}
    want = {"sensitivity": 0.9, "specificity": 0.9, "ppv": 0.8181818182, "npv": 0.9473684211, "lr_pos": 9, "lr_neg": 0.1111111111, "dor": 81, "youden": 0.8, "f1": 0.8571428571, "mcc": 0.7825855809, "prevalence": 0.3333333333, "balanced_accuracy": 0.9, "accuracy": 0.9}
    assert {k: m[k]["est"] for k in want} == pytest.approx(want, abs=1e-9)
    assert (m["sensitivity"]["ci_lo"], m["sensitivity"]["ci_hi"]) == pytest.approx((0.8256343385, 0.9447708629), abs=1e-9)
    found = ci.predictive_at_prevalence(*lits(90, 100, 180, 200, 0.05))
    assert tuple(values(spark, found["ppv"][0], found["npv"][0])) == pytest.approx((0.3214285714, 0.9941860465), abs=1e-9)


def test_empty_cells_have_reasons(spark):
    c = spark.createDataFrame([("a", "x", "op1", 0, 0, 0, 0), ("a", "y", "op1", 0, 3, 0, 4)], "attribute string, level string, op string, tp long, fn long, fp long, tn long")
    assert all(r["est"] is None for r in counts.metric_family(c).where("level = 'x'").collect())
    w = counts.with_wilson(counts.proportions(c)).collect()
    assert all((r["reason"] == "zero_denominator") == (r["n"] == 0) and (r["est"] is None) == (r["n"] == 0) for r in w)
    assert {r["metric"]: r["est"] for r in counts.metric_family(c).where("level = 'y'").collect()}["dor"] is None


def scores(spark):
    return spark.createDataFrame(list(zip(Y, S1, S2)), "y int, score double, prior double").withColumn("g", F.lit("all"))


def test_auroc_and_delong(spark):
    for score, auc, se in (("score", 0.8, 0.15491933384829668), ("prior", 0.64, 0.1979898987322333)):
        r = ranks.auroc(scores(spark), ["g"], score).first()
        assert (r["auc"], r["se"]) == pytest.approx((auc, se), abs=1e-12)
    r = ranks.auroc_interval(ranks.auroc(scores(spark), ["g"])).first()
    assert r["method"] == "delong_logit" and (r["ci_lo"], r["ci_hi"]) == pytest.approx((0.3748577492, 0.9638765619), abs=1e-9)
    d = ranks.paired_delong(scores(spark), ["g"]).first()
    assert (d["est"], d["se"] ** 2, d["z"], d["ci_lo"], d["ci_hi"]) == pytest.approx((0.16, 0.0072, 1.8856180832, -0.0063084589, 0.3263084589), abs=1e-9)


def test_auroc_does_not_depend_on_partitions(spark):
    got = {n: ranks.auroc(scores(spark).repartition(n), ["g"]).first() for n in (1, 7, 16)}
    assert len(set(got.values())) == 1


def test_auroc_reasons(spark):
    rows = spark.createDataFrame([("one", 1, 0.5), ("few", 1, 0.5), ("few", 0, 0.2), ("sep", 1, 0.9), ("sep", 1, 0.8), ("sep", 0, 0.1), ("sep", 0, 0.2)], "g string, y int, score double")
    got = {r["g"]: r["reason"] for r in ranks.auroc_interval(ranks.auroc(rows, ["g"])).collect()}
    assert got == {"one": "single_class", "few": "insufficient_positives", "sep": "boundary_estimate"}


def test_roc_has_a_vertex_per_score(spark):
    r = ranks.roc_curve(scores(spark), ["g"]).orderBy(F.desc("threshold")).collect()
    assert [x["tp"] for x in r] == [1, 2, 2, 3, 4, 4, 4, 5, 5, 5, 0] and r[-2]["fpr"] == 1
    assert tuple(r[-1][c] for c in ("threshold", "tp", "fp", "tpr", "fpr")) == (None, 0, 0, 0, 0)  # the start


def test_buckets_never_fall(spark):
    tiny = 5e-324
    x = sorted([-1e300, -7.5, -1.0, -0.3, -tiny, 0.0, tiny, 1e-9, 0.25, 0.4999999, 0.5, 0.5000000001, 0.7, 0.99, 1 - 2**-53, 1.0, 1.5, 8.0, 1e300, *np.random.default_rng(0).random(300).tolist()])
    b = [r["b"] for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", ranks.bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert b == sorted(b) and None not in b and b[x.index(-tiny)] < b[x.index(0.0)] < b[x.index(tiny)]


def test_running_sums_equal_a_window(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, float(v), int(n)) for k in ("a", None) for v, n in zip(r.permutation(400) / 399 - 0.2, r.integers(0, 5, 400))], "k string, s double, n int")
    got = {(x["k"], x["s"]): (x["n_before"], x["n_all"]) for x in ranks.cumulated(rows, ["k"], "s", ["n"]).collect()}
    want = rows.selectExpr("k", "s", "coalesce(sum(n) over (partition by k order by s rows between unbounded preceding and 1 preceding), 0) b", "sum(n) over (partition by k) a").collect()
    assert got == {(x["k"], x["s"]): (x["b"], x["a"]) for x in want}


def test_rank_plans_have_no_window_over_a_whole_key(spark):
    rows = spark.range(50).selectExpr("'all' as g", "cast(id % 2 as int) as y", "id / 50 as score", "(50 - id) / 50 as prior", "id")
    for df in (ranks.auroc(rows, ["g"]), ranks.roc_curve(rows, ["g"]), ranks.midranks(rows, "score"), ranks.paired_delong(rows, ["g"]), calibration.mass_bins(rows, "score", "id")):
        plan = [x.lstrip(" :+-") for x in df._jdf.queryExecution().analyzed().toString().split("\n")]
        whole = [k for k, x in enumerate(plan) if x.startswith("Window") and "_bucket" not in x.split("windowspecdefinition(", 1)[1].split("specifiedwindowframe")[0]]
        for k in whole:  # over the small table of buckets only
            below = next(x for x in plan[k:] if not x.startswith(("Window", "Project")))
            assert below.startswith("Aggregate") and "_bucket" in below.split("]")[0], below


def test_holm(spark):
    t = spark.createDataFrame([("f", 0.012), ("f", 0.04), ("f", 0.30)], "family string, p double")
    assert [r["p_holm"] for r in ranks.holm(t, ["family"]).orderBy("p").collect()] == pytest.approx([0.036, 0.08, 0.30])


def test_homogeneity(spark):
    c = spark.createDataFrame([("a", v, "op", "sensitivity", k, n) for v, k, n in (("x", 45, 50), ("y", 38, 50), ("z", 27, 30), (counts.UNKNOWN, 1, 9))], "attribute string, level string, op string, metric string, k long, n long")
    assert counts.homogeneity(c).first()["chi2"] == pytest.approx(4.6327272727, abs=1e-9)


def test_calibration(spark):
    rows = spark.createDataFrame(list(zip(F4_Y, F4_P)), "y int, score double").withColumn("g", F.lit("all"))
    r = calibration.summary(rows, ["g"]).first()
    assert (r["oe"], r["oe_lo"], r["oe_hi"], r["brier"], r["brier_ref"], r["ipa"]) == pytest.approx((1.1439466158, 0.7998311778, 1.6361125900, 0.158755, 0.24, 0.3385208333), abs=1e-9)
    fit = {x["parameter"]: x for x in calibration.recalibration(rows).collect()}
    got = [fit[n][c] for n in ("intercept_large", "slope", "intercept") for c in ("est", "se")]
    assert got == pytest.approx([0.4562304655, 0.5536866236, 1.1945124796, 0.5617458140, 0.4997716342, 0.5950556260], abs=1e-6)


def test_calibration_reasons(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, score double")
    apart = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], "y int, score double")
    assert [calibration.irls(x)[0]["reason"] for x in (one, flat, apart, one.where("false"))] == ["single_class", "constant_score", "complete_separation", "zero_denominator"]


def test_mass_bins_equal_ntile(spark):
    for n in (0, 3, 97, 200):
        rows = spark.range(n).select("id", F.round((F.col("id") * 37 % 11) / 11, 2).alias("score"))
        want = {r["id"]: r["b"] for r in rows.selectExpr("id", "ntile(10) over (order by score, id) - 1 as b").collect()}
        assert {r["id"]: r["bin"] for r in calibration.mass_bins(rows, "score", "id").collect()} == want


def test_equal_width_bins_are_right_closed(spark):
    p = [0.0, 0.1, 0.30000000000000004, 0.3, 0.6, 0.7, 0.95, 1.0]
    got = values(spark, *[calibration.equal_width_bin(F.lit(x)) for x in p])
    assert list(got) == [sum(i / 10 < x for i in range(1, 10)) for x in p]


def test_paired_join_counts(spark):
    a = spark.createDataFrame([("1", 1), ("2", 0), (None, 1), ("4", 1)], "id string, y int")
    b = spark.createDataFrame([("1", 1), ("2", 1), (None, 0), ("9", 1)], "id string, y int")
    assert tuple(compare.join_counts(a, b, "id").first()) == (1, 1, 2, 2, False)


def test_design_effect(spark):
    one = spark.createDataFrame([("c", i, i % 2) for i in range(20)], "g string, case string, hit int")
    assert counts.design_effect(one, "case", ["g"]).first()["deff"] == 1
    three = spark.createDataFrame([("c", i // 3, (i // 3) % 2) for i in range(60)], "g string, case string, hit int")
    r = counts.design_effect(three, "case", ["g"]).first()
    assert r["cases"] == 20 and r["deff"] == pytest.approx(3 * 20 / 19) and r["route"] == "wilson_deff"
    few = spark.createDataFrame([("c", i % 3, i % 2) for i in range(9)], "g string, case string, hit int")
    assert counts.design_effect(few, "case", ["g"]).first()["route"] == "below_coverage_bar"


def test_levels_add_up_to_overall(spark):
    rows = spark.createDataFrame([(i % 2, i / 100, "ab"[i % 2] if i % 7 else None, str(i % 3)) for i in range(100)], "y int, score double, a string, b string")
    got = counts.two_by_two(rows, ["a", "b"], [OperatingPoint("o", ">=", 0.5), OperatingPoint("p", "<", 0.2)])
    sums = {(r["attribute"], r["op"]): (r["n"],) for r in got.groupBy("attribute", "op").agg(F.sum(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n")).collect()}
    assert set(sums.values()) == {(100,)} and len(sums) == 6
    assert got.where(F.col("level") == counts.UNKNOWN).count() == 2


def test_flow_is_exclusive(spark):
    rows = spark.createDataFrame([("dev", None, None, True), ("test", None, None, True), ("test", "1", None, True), ("test", "1", 0.4, True), (None, "1", 0.4, None)], "d string, y string, s double, i boolean")
    got = [r[0] for r in rows.select(counts.flow_state(F.col("d"), F.col("y"), F.col("s"), F.col("i"))).collect()]
    assert got == ["dev", "missing_label", "missing_score", "indeterminate", "analysed"]


def test_bands(spark):
    ages = spark.createDataFrame([(0.0,), (39.9,), (40.0,), (200.0,), (None,)], "a double")
    assert [r[0] for r in ages.select(counts.band(F.col("a"), [(0, 40), (40, 65)])).collect()] == ["0-40", "0-40", "40-65", counts.UNKNOWN, counts.UNKNOWN]


def test_bootstrap(spark):
    r = resample.bootstrap_auroc(scores(spark), ["g"]).first()
    assert r["ci_lo"] == pytest.approx(0.44, abs=0.06) and r["ci_hi"] == pytest.approx(1.0, abs=0.02)
    again = resample.bootstrap_auroc(scores(spark).repartition(5), ["g"]).first()
    assert r == again
    few = spark.createDataFrame([("c", i % 3, i % 2) for i in range(9)], "g string, case string, hit int")
    assert resample.bootstrap_clustered_proportion(few, "case", ["g"]).first()["reason"] == "fewer_than_five_cases"


def test_clustered_bootstrap_covers_the_area(spark):
    rows = spark.range(2000).select((F.col("id") % 2).cast("int").alias("y"), (F.rand(3) + 0.3 * (F.col("id") % 2)).alias("score"), (F.col("id") % 400).alias("case")).withColumn("g", F.lit("all")).cache()
    auc = ranks.auroc(rows, ["g"]).first()["auc"]
    r = resample.bootstrap_clustered_auroc(rows, "case", ["g"], b=60).first()
    assert r["ci_lo"] < auc < r["ci_hi"] and r["ci_hi"] - r["ci_lo"] < 0.1


def test_criteria(spark):
    cells = counts.with_wilson(spark.createDataFrame([("overall", "all", "op1", "sensitivity", 90, 100), ("overall", "all", "op1", "ppv", 0, 0)], "attribute string, level string, op string, metric string, k long, n long"))
    rows = [("A", "overall", "all", "op1", "sensitivity", "ci_lower_bound", ">=", 0.8), ("B", "overall", "all", "op1", "sensitivity", "ci_lower_bound", ">=", 0.97), ("C", "overall", "all", "op1", "ppv", "estimate", ">", 0.1), ("D", "x", "y", "op1", "ppv", "estimate", ">", 0.1)]
    got = {r["id"]: (r["status"], r["reason"], r["attainable"]) for r in criteria.evaluate(spark.createDataFrame(rows, "id string, attribute string, level string, op string, metric string, statistic string, comparator string, value double"), cells).collect()}
    assert got == {"A": ("met", None, True), "B": ("not_met", None, False), "C": ("not_assessable", "no_interval", None), "D": ("not_assessable", "cell_not_found", None)}


def test_suppression_and_pseudonyms(spark):
    c = counts.with_wilson(spark.createDataFrame([("a", "x", "o", "m", 5, 10), ("a", "y", "o", "m", 4, 30), ("a", "z", "o", "m", 5, 9)], "attribute string, level string, op string, metric string, k long, n long"))
    got = {r["level"]: (r["suppressed"], r["est"]) for r in criteria.project(c).collect()}
    assert got == {"x": (False, 0.5), "y": (True, None), "z": (True, None)}
    levels = spark.createDataFrame([("site", f"s{i:02}") for i in range(30)] + [("sex", "F"), ("sex", "unspecified")], "attribute string, level string")
    names = {(r["attribute"], r["level"]): r["pseudonym"] for r in criteria.pseudonyms(levels, ("site",)).collect()}
    assert names["site", "s00"] == "Site A" and names["site", "s25"] == "Site Z" and names["site", "s26"] == "Site AA" and names["sex", "F"] == "F" and names["sex", "unspecified"] == "Sex B"


def test_gates(spark):
    raw = spark.createDataFrame([("1", 0.2, "r1"), ("2", 1.3, "r1"), ("0", None, None)], "y_true string, score double, row_id string")
    a = spark.createDataFrame([(1, 0.2, False, "s", "c"), (0, 0.6, False, "s", "c"), (0, 0.7, True, "t", "d")], "y int, score double, y_pred_positive boolean, site string, case string")
    got = {r["code"]: r["n"] for r in gates.gate_report(raw, a, ("0", "1"), OperatingPoint("o", ">=", 0.5), 0.9, "site", "case").collect()}
    assert got == {"H02": 1, "H03": 1, "H05": 1, "H06": 0, "H01": 1, "H04": 1, "H08": 0, "W10": 1, "W06": 1, "W13": 1}
    said = raw.withColumn("y_pred", F.when(F.col("score") > 1, "0").when(F.col("score") < 1, "yes"))
    assert {r["code"]: r["n"] for r in gates.gate_report(said, a, ("0", "1"), OperatingPoint("o", ">=", 0.5), 0.9, "site", "case").collect()}["H02"] == 2


def test_normalised_cells(spark):
    cells = ["\tS1\n\x85 ", "  ", "NA", "unknown", "UNKNOWN ", "x y", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(ingest.normalise(F.col("c"))).collect()]
    assert got == ["S1", None, None, None, None, "x y", None]


def test_numbers(spark):
    cells = ["1", "1d", "1_000", ".5", "1e3", "-2.", "0x1", "+3"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(ingest.to_double(F.col("c"))).collect()]
    assert got == [1.0, None, 1000.0, 0.5, 1000.0, -2.0, None, 3.0]


def test_dates(spark):
    got = values(spark, *[ingest.coarsen(F.lit(d), g) for d, g in (("2024-05-09", "quarter"), ("2024-05-09", "month"), ("2024-13-01", "year"), ("May", "year"), ("2024-12-31T00", "year"))])
    assert list(got) == ["2024-Q2", "2024-05", None, None, "2024"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfid, score\n1,0.5\n,\n\"a\nb\",x\n")
    df = ingest.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "score"] and [tuple(r) for r in df.collect()] == [("1", "0.5"), ("a\nb", "x")]
    typed = ingest.typed(df, doubles=["score"]).collect()
    assert [r["n_bad"] for r in typed] == [0, 1]
    (tmp_path / "b.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ingest.InputError, match="S04"):
        ingest.read_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("id,x\n1,2\n1\n")
    with pytest.raises(ingest.InputError, match="S04"):
        ingest.read_csv(spark, str(tmp_path / "c.csv"))


def test_json(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"a": 1, "b": true}, {"b": "x", "c": 2.5}]')
    assert sorted(ingest.read_json(spark, str(tmp_path / "r.json")).columns) == ["a", "b", "c"]
    (tmp_path / "c.json").write_text('{"columns": {"a": [1, 2], "b": ["x", null]}}')
    assert [tuple(r) for r in ingest.read_json(spark, str(tmp_path / "c.json")).collect()] == [("1", "x"), ("2", None)]
    (tmp_path / "d.json").write_text('{"columns": {"a": [1, 2], "b": ["x"]}}')
    with pytest.raises(ingest.InputError, match="S04"):
        ingest.read_json(spark, str(tmp_path / "d.json"))


def test_headers():
    got = ingest.map_headers(["PredictedProbability", "SepsisLabel", "Gender", "hospital", "patient_id", "HR", "attr_x1", "subject_id"])
    assert {k: v[0] for k, v in got.items()} == {"PredictedProbability": "score", "SepsisLabel": "y_true", "Gender": "sex", "hospital": "site", "patient_id": "case_id", "HR": "ignored", "attr_x1": "attr_x1", "subject_id": "case_id"}
    assert got["patient_id"][1] == "low" and got["Gender"][1] == "high"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id") * 20)).alias("ts"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 10 / 10).alias("score"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), OperatingPoint("o", ">=", 0.5))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, windowed_counts(rows, OperatingPoint("o", ">=", 0.5)).collect()))


def test_expit_and_logit(spark):
    got = values(spark, ci.expit(F.lit(800.0)), ci.expit(F.lit(-800.0)), ci.logit(F.lit(0.0)), ci.expit(ci.logit(F.lit(0.25))))
    assert tuple(got) == pytest.approx((1, 0, math.log(1e-12), 0.25), abs=1e-9)
