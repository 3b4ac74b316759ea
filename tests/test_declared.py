"""Declarations, mapping and date gates, generated cohorts, keys and the clustered resampling operators."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import calibration, compare, counts, criteria, gates, keys, ranks, resample
from cohortlens.sources import cohort, declare, ingest

YAML = """
schema_version: 1
model: {name: m, version: 2.10}
task: binary
classes: {positive: 1, negative: 0}
score: {type: probability, orientation: higher_is_positive}
operating_points: [{id: op1, threshold: 0.5, rule: ">=", provenance: other}]
reference_standard: {type: comparator, description: d}
indeterminates: {policy: none_present}
clustering: {unit: case_id}
prevalence: [{label: here, value: 0.2}]
subgroups:
- {attribute: sex, prespecified: true, reference_level: F}
- {attribute: age, prespecified: true, bands: [[0, 40], [40, 200]]}
criteria:
- {id: C1, metric: sensitivity, operating_point: op1, scope: {attribute: sex, level: M}, author: a, date: 2026-01-02, justification: j}
egress: {suppression: {min_n: 20, min_events: 1}}
"""


def levels(spark, found):
    return spark.createDataFrame([(a, x) for a, xs in found.items() for x in sorted(xs)], "attribute string, level string")


def test_declarations_keep_text_and_only_tighten(spark):
    d = declare.parse(YAML)
    assert (d.version, d.positive, d.points[0].threshold, d.clustered, d.criteria[0]["date"]) == ("2.10", "1", 0.5, True, "2026-01-02")
    assert d.suppression == (20, 5, 5) and d.bands["age"] == [(0, 40), (40, 200)] and d.references == {"sex": "F", "age": None}
    declare.check_levels(d, levels(spark, {"sex": {"F", "M"}}), numeric_age=True)


@pytest.mark.parametrize(
    ("old", "new", "code"),
    [("task: binary\n", "", "H08"), ("operating_point: op1", "operating_point: op9", "H09"), ("metric: sensitivity", "metric: magic", "H09"), ("author: a", "author: ''", "H08"), ("threshold: 0.5", "threshold: x", "H08"), ("metric: sensitivity", "metric: auroc", "H09"), ('rule: ">="', "rule: '='", "H08"), ("negative: 0", "negative: 1", "H08"), ("unit: case_id", "unit: site", "E01"), ("attribute: age", "attribute: sex", "H08"), ("id: op1", "id: overall", "H08"), ("task: binary", "task: binary\ny_pred_operating_point: op7", "H09"), ("[0, 40]", "[40, 0]", "H08")],
)
def test_declarations_are_refused(old, new, code):
    with pytest.raises(ingest.InputError, match=code):
        declare.parse(YAML.replace(old, new))


def test_all_declared_problems_are_named():
    with pytest.raises(ingest.InputError, match="H08: criterion C1 .*H08: the two classes.*H09: criterion C1"):
        declare.parse(YAML.replace("author: a", "author: ''").replace("negative: 0", "negative: 1").replace("operating_point: op1", "operating_point: op9"))


def test_declared_levels_must_be_there(spark):
    d = declare.parse(YAML)
    for found, age, code in (({}, True, "H09.*criterion C1, subgroup sex"), ({"sex": {"M"}}, True, "H09.*subgroup sex$"), ({"sex": {"F"}}, True, "H09.*criterion C1$"), ({"sex": {"F", "M"}}, False, "H09.*subgroup age$")):
        with pytest.raises(ingest.InputError, match=code):
            declare.check_levels(d, levels(spark, found), age)
    with pytest.raises(ingest.InputError, match="H08"):
        declare.check_levels(declare.parse(YAML.replace(", bands: [[0, 40], [40, 200]]", "")), levels(spark, {"sex": {"F", "M"}}), True)


def test_renaming(spark):
    df = spark.createDataFrame([("1", "0.5", "x")], ["Label", "p", "site"])
    assert ingest.renamed(df, {"Label": "y_true", "p": "score"}).columns == ["y_true", "score", "ignored:site"]
    for roles, code in (({"Label": "score", "p": "score"}, "H07"), ({"Label": "case_id", "p": "case_id"}, "E01"), ({"none": "score"}, "H07")):
        with pytest.raises(ingest.InputError, match=code):
            ingest.renamed(df, roles)


def test_dates_and_extremes(spark):
    rows = [(f"{d} sept 2024", "1.1.2020", f"2024-0{1 + d // 20}-01", str(d), None) for d in range(1, 31)]
    df = spark.createDataFrame(rows, "a string, visit_date string, c string, d string, e string")
    found = {r["column"]: r["date_like"] for r in ingest.date_like(df, df.columns).collect()}
    assert found == {"a": True, "visit_date": True, "c": True, "d": False, "e": False}
    assert not any(r["date_like"] for r in ingest.date_like(df.where("false").select("a", "d"), ["a", "d"]).collect())
    assert gates.uncovered_dates(ingest.date_like(df, df.columns), "a").first()["n"] == 2
    assert gates.uncovered_dates(ingest.date_like(df, ["a", "d"]), "a").first()["halts"] is False
    assert {r["column"]: tuple(r)[1:] for r in ingest.extremes(df, ["c", "d", "a"]).collect()} == {"c": ("2024-01", "2024-02"), "d": ("<suppressed>", "<suppressed>"), "a": (None, None)}


def test_pairing(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "id string"), spark.createDataFrame([("y",), ("z",), ("z",)], "id string")
    assert tuple(gates.pairing(a, b, "id").first()) == ("H12", 2, True)
    assert tuple(gates.pairing(a, b, "id", allow_unpaired=True).first()) == ("W12", 2, False)
    assert tuple(gates.pairing(a, a, "id").first()) == ("H12", 0, False)
    with pytest.raises(gates.Halt, match="H12"):
        gates.pairing(a, b.withColumnRenamed("id", "other"), "id", allow_unpaired=True)


def test_the_first_gate_halts(spark):
    raw = spark.createDataFrame([("r1", "c1", "1", 0.9), ("r2", "c1", "0", 0.2), ("r3", "c2", "0", 0.1), ("r4", "c2", "1", 0.6)], "row_id string, case string, y_true string, score double")
    a = raw.select("case", F.col("y_true").cast("int").alias("y"), "score", F.lit("s").alias("site"), (F.col("score") >= 0.5).alias("y_pred_positive"))
    point = counts.OperatingPoint("o", ">=", 0.5)
    with pytest.raises(gates.Halt, match="H05: 2"):
        gates.halt_on(gates.gate_report(raw, a, ("0", "1"), point, 0.5, "site", "case", clustered=False))
    assert gates.halt_on(gates.gate_report(raw, a, ("0", "1"), point, 0.5, "site", "case")) == ["W13"]
    blind = raw.withColumn("score", F.lit(None).cast("double"))
    got = {r["code"]: r["n"] for r in gates.gate_report(blind, a, ("0", "1"), point, 0.5, "site", "case", points=2).collect()}
    assert got["H08"] == 2 and got["H05"] == 0


def test_cohort_is_the_same_in_any_partitions(spark):
    c = cohort.make_cohort(spark, n=4000)
    again = cohort.make_cohort(spark, n=4000).repartition(7)
    assert c.exceptAll(again).isEmpty() and c.count() == 4000
    r = c.agg(F.avg(F.col("y_true").cast("int")).alias("p"), F.min("age").alias("lo"), F.max("age").alias("hi"), F.count_distinct("site").alias("s")).first()
    assert abs(r["p"] - 0.3) < 0.03 and (r["lo"], r["hi"], r["s"]) == (18, 94, 3)
    area = lambda d: ranks.auroc(d.select(F.lit(1).alias("k"), F.col("y_true").cast("int").alias("y"), "score"), ["k"]).first()["auc"]
    assert 0.82 < area(c) < 0.89 and 0.7 < area(cohort.perturbed(c)) < area(c)


def test_key_follows_order_and_nulls(spark):
    def key(values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "at long, v string").repartition(3)
        return keys.test_set_key(df, "at", [F.col("v")], len(values)).first()["key"]

    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert key(["a", None]) == hexed(hexed("1:a") + hexed("-")) and key([]) == hexed("") and key(["ab"]) == hexed("2:ab")
    assert len({key(["a", "b"]), key(["b", "a"]), key(["a", ""]), key(["a", None])}) == 4
    many = [str(i) for i in range(keys.FAN + 2)]
    leaf = [hexed(f"{len(v)}:{v}") for v in many]
    assert key(many) == hexed(hexed("".join(leaf[: keys.FAN])) + hexed("".join(leaf[keys.FAN :])))


def _clustered(spark, n_cases=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for case in range(n_cases):
        tilt = rng.normal(0, 0.5)
        for _ in range(rng.integers(1, 4)):
            s = round(float(1 / (1 + np.exp(-rng.normal(tilt, 1)))), 3)
            rows.append((case, "a" if case % 2 else "b", s, int(rng.random() < s)))
    return rows, spark.createDataFrame(rows, "case long, level string, score double, y int").withColumn("k", F.lit("all"))


def test_clustered_calibration_against_whole_case_draws(spark):
    rows, df = _clustered(spark)
    got = {r["metric"]: r for r in resample.bootstrap_clustered_calibration(df, "case", ["k"], b=200).collect()}
    by_case, rng, draws = {}, np.random.default_rng(5), []
    for case, _, s, y in rows:
        by_case.setdefault(case, []).append((s, y))
    cases = [np.array(v) for v in by_case.values()]
    for _ in range(300):
        x = np.concatenate([cases[i] for i in rng.integers(0, len(cases), len(cases))])
        draws.append((x[:, 1].sum() / x[:, 0].sum(), ((x[:, 0] - x[:, 1]) ** 2).mean()))
    for name, values in zip(("oe", "brier"), np.array(draws).T, strict=True):
        lo, hi = np.quantile(values, [0.025, 0.975])
        assert abs(got[name]["ci_lo"] - lo) < 0.3 * (hi - lo) and abs(got[name]["ci_hi"] - hi) < 0.3 * (hi - lo)
    fit = calibration.irls(df)[0]
    assert got["slope"]["ci_lo"] < fit["est"][1] < got["slope"]["ci_hi"] and got["intercept"]["draws"] == 200
    h = df.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")).toPandas()
    x = h["score"].to_numpy()
    assert resample.logistic_fit(np.log(x / (1 - x)), h["p"].to_numpy(float), h["q"].to_numpy(float)) == pytest.approx(fit["est"], abs=1e-6)


def test_clustered_calibration_refusals(spark):
    df = spark.createDataFrame([(1, 0.5, 1, "all"), (2, 0.6, 1, "all")], "case long, score double, y int, k string")
    got = {r["metric"]: (r["draws"], r["ci_lo"], r["reason"]) for r in resample.bootstrap_clustered_calibration(df, "case", ["k"], b=20).collect()}
    assert got == {m: (0, None, "single_class") for m in ("oe", "brier", "intercept", "slope")}  # a class is absent, whatever the draws
    few = spark.createDataFrame([(c, (3 * c + k) / 20, (c + k) % 2, "all") for c in (1, 2, 3) for k in range(3)], "case long, score double, y int, k string")
    got = {r["metric"]: (r["ci_lo"], r["reason"]) for r in resample.bootstrap_clustered_calibration(few, "case", ["k"], b=200).collect()}
    area = resample.bootstrap_clustered_auroc(few, "case", ["k"], b=200).first()
    assert area["reason"] == "fewer_than_five_cases" and got["brier"] == (None, "fewer_than_five_cases") and all(lo is None for lo, _ in got.values())
    assert resample.bootstrap_clustered_calibration(df.where("false"), "case", ["k"], b=20).count() == 0


@pytest.mark.parametrize("rows", [40, 7])
def test_hot_buckets_are_cut_without_changing_sums(spark, monkeypatch, rows):
    data = [(c, 0.7 + 1e-6 * ((c * 7 + k) % 60) if k else 0.7, (c * k + c // 3) % 2, "all") for c in range(90) for k in range(4)]  # all in one bucket, one score frequent
    df = spark.createDataFrame(data, "case long, score double, y int, k string")
    value = lambda: {r["b"]: r["value"] for r in resample.clustered_areas(df, "case", ["k"], 30).collect()}
    fits = lambda: {(r["b"], r["metric"]): r["value"] for r in resample.clustered_calibration(df, "case", ["k"], 30).collect()}
    whole, of = value(), fits()
    monkeypatch.setattr(resample, "ROWS", rows)
    assert value() == pytest.approx(whole, abs=1e-12)
    cut = fits()
    assert {k: v for k, v in cut.items() if k[1] in ("oe", "brier")} == pytest.approx({k: v for k, v in of.items() if k[1] in ("oe", "brier")}, abs=1e-9)
    cells = df.groupBy("k", "case", F.col("score").alias("s")).agg(F.count("*").alias("n")).withColumn("bucket", F.lit(5).cast("long"))
    parted = resample._parted(cells, ["k"])
    by = parted.groupBy("bucket").agg(F.min("s").alias("a"), F.max("s").alias("b")).orderBy("bucket").collect()
    assert len(by) > 5 and all(x["b"] < y["a"] for x, y in zip(by, by[1:]))


def test_clustered_difference(spark):
    rows, df = _clustered(spark)
    hits = df.withColumn("hit", F.col("y"))
    r = resample.bootstrap_clustered_difference(hits, "case", "level", ["k"], "b", b=1000).first()
    rate = lambda lv: np.mean([y for _, x, _, y in rows if x == lv])
    assert r["est"] == pytest.approx(rate("a") - rate("b")) and r["ci_lo"] < r["est"] < r["ci_hi"] and r["cases"] == 200
    units = {lv: {} for lv in "ab"}
    for case, lv, _, y in rows:
        units[lv].setdefault(case, []).append(y)
    v = sum(len(u) / (len(u) - 1) * sum((sum(c) - rate(lv) * len(c)) ** 2 for c in u.values()) / sum(map(len, u.values())) ** 2 for lv, u in units.items())
    assert (r["ci_hi"] - r["ci_lo"]) / (2 * 1.96 * v**0.5) == pytest.approx(1, abs=0.12)
    shared = hits.unionByName(hits.where("case = 0").withColumn("level", F.lit("a")))
    assert resample.bootstrap_clustered_difference(shared, "case", "level", ["k"], "b", b=50).first()["reason"] == "cases_span_both_groups"
    few = hits.where("case < 8 or level = 'b'")
    assert resample.bootstrap_clustered_difference(few, "case", "level", ["k"], "b", b=50).first()["reason"] == "fewer_than_five_cases"
    flat = hits.withColumn("hit", F.when(F.col("level") == "a", 1).otherwise(F.col("hit")))
    assert resample.bootstrap_clustered_difference(flat, "case", "level", ["k"], "b", b=50).first()["reason"] == "boundary_estimate"
    assert resample.bootstrap_clustered_difference(hits.where("level = 'a'"), "case", "level", ["k"], "b", b=50).first()["reason"] == "zero_denominator"


def test_drawing_in_blocks_changes_nothing(monkeypatch):
    c, v = np.array([3, 5, 9]), np.array([1.0, 2.0, 4.0])
    whole = resample.drawn(np.random.default_rng(1), c, 50, v)[0]
    monkeypatch.setattr(resample, "CHUNK", 7)
    assert (resample.drawn(np.random.default_rng(1), c, 50, v)[0] == whole).all()


def test_brier_interval(spark):
    rows, df = _clustered(spark)
    r = resample.bootstrap_brier(df, ["k"], b=1000).first()
    losses = {c: np.array([(s - y) ** 2 for _, _, s, y in rows if y == c]) for c in (0, 1)}
    n = len(rows)
    assert r["est"] == pytest.approx(np.concatenate(list(losses.values())).mean()) and r["n"] == n
    half = 1.96 * sum(len(x) * x.var() for x in losses.values()) ** 0.5 / n
    assert (r["ci_hi"] - r["ci_lo"]) / 2 == pytest.approx(half, rel=0.12)
    assert resample.bootstrap_brier(df.where("y = 1"), ["k"], b=20).first()["reason"] == "single_class"


def test_class_strata(spark):
    def strata(*cases):
        rows = [(i, y, "all") for i, ys in enumerate(cases) for y in ys]
        return resample.class_strata(spark.createDataFrame(rows, "case long, y int, k string"), "case", ["k"]).first()

    r = strata([1], [0, 1], *[[0]] * 6)
    assert (r["units_pos"], r["units_neg"], r["units_mixed"], r["frozen_pos"], r["deficient"]) == (1, 6, 1, 1.0, "positive")
    r = strata([1] * 5, [0, 1], [0, 1], *[[0]] * 10)
    assert r["frozen_pos"] == pytest.approx(25 / 27) and r["deficient"] == "positive"
    r = strata(*[[1]] * 3, *[[0]] * 4)
    assert r["deficient"] is None and r["invariant"] is True
    assert strata([1], [1, 1], [1], *[[0]] * 4)["invariant"] is False
    assert strata(*[[1]] * 3, [0] * 4)["deficient"] == "negative"


def test_unpaired_versions(spark):
    cell = lambda k, n: spark.createDataFrame([("m", k, n)], "metric string, k long, n long")
    r = compare.unpaired_differences(cell(56, 70), cell(48, 80), ["metric"]).first()
    assert (round(r["est"], 4), round(r["ci_lo"], 4), round(r["ci_hi"], 4), r["flag"], r["reason"]) == (0.2, 0.0524, 0.3339, "not_like_for_like", None)
    assert compare.unpaired_differences(cell(0, 0), cell(1, 2), ["metric"]).first()["reason"] == "zero_denominator"


def _area(s, y):
    s, y = np.asarray(s), np.asarray(y)
    gap = s[y == 1][:, None] - s[y == 0][None, :]
    return float(((gap > 0) + (gap == 0) / 2).mean())


def _whole_cases(rows, case_of, statistic, b=400, seed=5):
    by_case = {}
    for r in rows:
        by_case.setdefault(case_of(r), []).append(r)
    cases, rng = list(by_case.values()), np.random.default_rng(seed)
    return np.array([statistic([r for i in rng.integers(0, len(cases), len(cases)) for r in cases[i]]) for _ in range(b)])


def test_clustered_area_difference(spark):
    rows, df = _clustered(spark)
    r = resample.bootstrap_clustered_area_difference(df, "case", "level", ["k"], "b", b=200).first()
    sides = {lv: [x for x in rows if x[1] == lv] for lv in "ab"}
    area = lambda part: _area([x[2] for x in part], [x[3] for x in part])
    assert r["est"] == pytest.approx(area(sides["a"]) - area(sides["b"])) and (r["level"], r["cases"], r["reason"]) == ("a", 200, None)
    spread = np.std(_whole_cases(sides["a"], lambda x: x[0], area) - _whole_cases(sides["b"], lambda x: x[0], area, seed=6))
    assert (r["ci_hi"] - r["ci_lo"]) / (2 * 1.96) == pytest.approx(spread, rel=0.25) and r["ci_lo"] < r["est"] < r["ci_hi"]
    reason = lambda d: resample.bootstrap_clustered_area_difference(d, "case", "level", ["k"], "b", b=20).first()["reason"]
    assert reason(df.unionByName(df.where("case = 0").withColumn("level", F.lit("a")))) == "cases_span_both_groups"
    assert reason(df.where("case < 8 or level = 'b'")) == "fewer_than_five_cases"
    assert reason(df.where("case < 20 or level = 'b'")) == "insufficient_class_rows"
    assert reason(df.where("level = 'a'")) == "zero_denominator"
    assert reason(df.withColumn("score", F.when(F.col("level") == "a", F.col("y")).otherwise(F.col("score")))) == "boundary_estimate"
    assert resample.bootstrap_clustered_area_difference(df.where("false"), "case", "level", ["k"], "b", b=20).count() == 0


def test_resamples_are_two_thousand(spark, monkeypatch):
    import inspect

    for name in ("bootstrap_clustered_auroc", "bootstrap_clustered_calibration", "bootstrap_clustered_area_difference", "bootstrap_clustered_paired", "bootstrap_auroc", "bootstrap_paired_brier"):
        assert inspect.signature(getattr(resample, name)).parameters["b"].default == resample.B == 2000
    _, df = _clustered(spark)
    exact = resample.bootstrap_clustered_auroc(df, "case", ["k"]).first()
    monkeypatch.setattr(resample, "SMALL", 0)
    monkeypatch.setattr(resample, "ROWS", 40)
    hashed = resample.bootstrap_clustered_auroc(df, "case", ["k"]).first()
    assert exact["draws"] == hashed["draws"] == 2000
    width = exact["ci_hi"] - exact["ci_lo"]
    assert all(abs(exact[x] - hashed[x]) < 0.1 * width for x in ("ci_lo", "ci_hi"))
    weights = resample.hashed_weights(np.random.default_rng(1).integers(-(2**62), 2**62, 5000), 100, 98).astype(float)
    assert weights.shape == (5000, 98) and weights.mean() == pytest.approx(1, abs=0.01) and weights.var() == pytest.approx(1, abs=0.02)


def test_clustered_area_refuses_what_draws_cannot_vary(spark):
    def reason(cases):
        rows = [(c, y, s, "all") for c, labels in enumerate(cases) for y, s in labels]
        df = spark.createDataFrame(rows, "case long, y int, score double, k string")
        return resample.bootstrap_clustered_auroc(df, "case", ["k"], b=200).first()

    neg = [[(0, 0.1 + 0.01 * i), (0, 0.5 + 0.01 * i)] for i in range(40)]
    pos = [[(1, 0.3 + 0.02 * i), (1, 0.4)] for i in range(20)]
    assert reason([*neg, *pos])["reason"] is None
    heavy = [[(1, 0.3 + 0.004 * i) for i in range(100)]]
    assert reason([*neg, *heavy, [(1, 0.35), (0, 0.2)]])["reason"] == "insufficient_clusters"
    assert reason(neg)["reason"] == "single_class"
    few = reason([[(0, 0.1), (0, 0.5)], [(0, 0.4)], [(1, 0.3)], [(1, 0.6)]])
    assert (few["reason"], few["ci_lo"]) == ("fewer_than_five_cases", None)


def test_clustered_paired(spark):
    rng = np.random.default_rng(3)
    rows = [(c, s, y, round(float(np.clip(s + rng.normal(0, 0.2), 0.001, 0.999)), 3)) for c, _, s, y in _clustered(spark)[0]]
    df = spark.createDataFrame(rows, "case long, score double, y int, prior double").withColumn("k", F.lit("all"))
    found = {r["metric"]: r for r in resample.bootstrap_clustered_paired(df, "case", ["k"], b=200).collect()}
    brier = lambda part: np.mean([(s - y) ** 2 - (p - y) ** 2 for _, s, y, p in part])
    area = lambda part: _area([x[1] for x in part], [x[2] for x in part]) - _area([x[3] for x in part], [x[2] for x in part])
    assert set(found) == {"auroc", "brier", "slope"}
    for metric, statistic in (("brier", brier), ("auroc", area)):
        r, spread = found[metric], np.std(_whole_cases(rows, lambda x: x[0], statistic))
        assert r["ci_lo"] < statistic(rows) < r["ci_hi"] and (r["ci_hi"] - r["ci_lo"]) / (2 * 1.96) == pytest.approx(spread, rel=0.25)
    assert found["slope"]["ci_lo"] > 0  # noise flattens the prior's slope
    same = resample.bootstrap_clustered_paired(df.withColumn("prior", F.col("score")), "case", ["k"], b=20).collect()
    assert {r["reason"] for r in same} == {"boundary_estimate"}

    point = counts.OperatingPoint("op1", ">=", 0.5)
    cells = {r["metric"]: r for r in compare.clustered_paired_differences(df, [point], "case", ["k"], b=1000).collect()}
    plain = {r["metric"]: r for r in compare.paired_differences(compare.paired_cells(df, [point], ["k"])).collect()}
    right = lambda part: np.mean([int((s >= 0.5) == (y == 1)) - int((p >= 0.5) == (y == 1)) for _, s, y, p in part])
    assert all(cells[m]["est"] == pytest.approx(plain[m]["est"]) for m in ("sensitivity", "specificity", "accuracy"))
    r = cells["accuracy"]
    assert (r["ci_hi"] - r["ci_lo"]) / (2 * 1.96) == pytest.approx(np.std(_whole_cases(rows, lambda x: x[0], right)), rel=0.15)
    assert cells["sensitivity"]["cases"] == len({c for c, _, y, _ in rows if y})


def test_roles_by_header_and_values(spark, tmp_path):
    rows = [(str(i), ("Yes", "no")[i % 2], str(i / 20), f"2024-01-{i + 1:02d}", str(i % 3), ("1", "2")[i % 2], f"{10 * (i % 4)}-{10 * (i % 4) + 9}", None, "word" if i else None, "0") for i in range(20)]
    names = ["k", "flag", "chance", "seen", "score", "gender", "age", "label", "note", "constant"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    found = {r["column"]: tuple(r)[1:] for r in ingest.propose(df, names).collect()}
    assert found == {
        "k": ("row_id", "medium", "values"),
        "flag": ("ignored", "high", "none"),  # y_true is claimed by the header label
        "chance": ("ignored", "high", "none"),
        "seen": ("event_date", "medium", "values"),
        "score": ("score", "high", "canonical"),
        "gender": ("sex", "medium", "synonym"),
        "age": ("age_band", "high", "canonical"),
        "label": ("y_true", "medium", "synonym"),
        "note": ("ignored", "high", "none"),
        "constant": ("ignored", "high", "none"),
    }
    apart = {r["column"]: tuple(r)[1:3] for r in ingest.propose(df.select("flag", "chance", F.col("flag").alias("other"), F.col("chance").alias("y_pred"), F.col("note").alias("event_date")), ["flag", "chance", "other", "y_pred", "event_date"]).collect()}
    assert apart == {"flag": ("y_true", "low"), "other": ("y_true", "low"), "chance": ("score", "medium"), "y_pred": ("y_pred", "low"), "event_date": ("event_date", "low")}
    empty = {r["column"]: r["role"] for r in ingest.propose(df.where("false"), names).collect()}
    assert set(empty) == set(names) and empty["label"] == "y_true" and empty["flag"] == "ignored"

    words = df.select(F.col("k").alias("nbr_of_patient"), F.col("score").alias("RiskAtDay1"), F.col("flag").alias("final label 2"), F.col("seen").alias("visit_date"), F.col("note").alias("label_source"), F.col("chance").alias("admission age"), F.col("constant").alias("site"), F.col("constant").alias("home_site"))
    told = {r["column"]: tuple(r)[1:] for r in ingest.propose(words, words.columns).collect()}
    assert told == {
        "nbr_of_patient": ("case_id", "medium", "partial"), "RiskAtDay1": ("score", "medium", "partial"),
        "final label 2": ("y_true", "low", "partial"), "label_source": ("y_true", "low", "partial"), "visit_date": ("event_date", "high", "date_header"), "admission age": ("age", "medium", "partial"),
        "site": ("site", "high", "canonical"), "home_site": ("site", "low", "partial"),
    }
    with pytest.raises(ingest.InputError, match="E01"):
        ingest.propose(df, ["patient_id", "subject_id"])
    with pytest.raises(ingest.InputError, match="H07"):
        ingest.propose(df, ["Age", "age "])

    proposal = ingest.propose(df, names)
    with pytest.raises(ingest.InputError, match="H07: 4 roles"):
        ingest.settle(proposal, {})
    roles = ingest.settle(proposal, {"k": "row_id", "seen": "ignored", "gender": "sex", "label": "y_true"})
    assert roles["seen"] == "ignored" and roles["score"] == "score"
    path = str(tmp_path / "mapping.json")
    digest = ingest.write_mapping(path, roles)
    assert ingest.read_mapping(path, names) == (roles, digest) and "y_true" in ingest.renamed(df, roles).columns
    for columns in (names[1:], [*names, "more"]):
        with pytest.raises(ingest.InputError, match="H07"):
            ingest.read_mapping(path, columns)
    (tmp_path / "mapping.json").write_text("[]")
    with pytest.raises(ingest.InputError, match="H07"):
        ingest.read_mapping(path, names)


def test_only_whitelisted_values_leave(spark):
    df = spark.createDataFrame([("a", 1, 0.5, True, "x"), ("b", None, None, False, None)], "level string, n long, est double, small boolean, secret string")
    schema = {"level": {"enum": ["a", "b"]}, "n": {"type": ["integer", "null"]}, "est": {"type": ["number", "null"]}, "small": {"type": "boolean"}}
    out = criteria.whitelisted(df, schema)
    assert out.columns == ["level", "n", "est", "small"] and out.count() == 2
    for name, rule in (
        ("level", {"enum": ["a"]}), ("level", {"type": "string"}), ("level", {"const": "a"}), ("level", {"type": "string", "pattern": "a|"}),
        ("n", {"type": "integer"}), ("est", {"type": ["integer", "null"]}), ("small", {"type": "string"}), ("secret", {"type": "string", "pattern": "x"}),
        ("level", {"type": "string", "pattern": "[ab]", "maxLength": 0}),
    ):
        with pytest.raises(criteria.NotAdmitted, match=name):
            criteria.whitelisted(df, {**schema, name: rule})
    assert criteria.whitelisted(df, {**schema, "secret": {"type": ["string", "null"], "pattern": "x"}}).count() == 2
    assert criteria.whitelisted(df.where("false"), {"level": {"enum": ["z"]}}).count() == 0
