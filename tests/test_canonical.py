"""Canonical files, digests and the comparison of runs against plain Python on the same rows."""

import datetime
import decimal
import json
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import canonical

SCHEMA = "id long, x double, name string, part struct<b:int,a:array<double>>, day date, cost decimal(9,2), raw binary, started string"


def rows(n=600, seed=1):
    r = random.Random(seed)
    return [(i, r.choice([0.1, 1e20, -0.0, 2.5, None, 1 / 3]), r.choice(["é", '"', "x\ny", None]), (i, [0.5, None]), datetime.date(2024, 1, 1 + i % 28), decimal.Decimal(i) / 4, bytes([i % 256]), f"run {seed}") for i in range(n)]


def test_lines_and_digest_do_not_depend_on_partitions(spark, tmp_path):
    data = rows()
    found, digests = [], []
    for parts in (1, 4, 32):
        df = spark.createDataFrame(data, SCHEMA).repartition(parts, F.rand(parts))
        path = tmp_path / str(parts)
        canonical.write_lines(df, str(path), ["id"], parts)
        found.append(b"".join(p.read_bytes() for p in sorted(path.glob("part-*"))))
        digests.append(canonical.digest(df.select(*reversed(df.columns))))
    assert found[0] == found[1] == found[2] and len(set(digests)) == 1 and len(digests[0]) == 64
    lines = found[0].decode().splitlines()
    assert [json.loads(x)["id"] for x in lines] == list(range(600))
    assert lines[1].startswith('{"cost":"0.25","day":"2024-01-02","id":1,"name":') and '"part":{"a":[0.5,null],"b":1},"raw":"AQ=="' in lines[1]
    assert canonical.digest(spark.createDataFrame(data[:-1], SCHEMA)) != digests[0]
    assert canonical.digest(spark.createDataFrame([*data, data[0]], SCHEMA)) != digests[0]
    assert canonical.digest(spark.createDataFrame([], SCHEMA)) == ""


def test_no_canonical_form_of_nan(spark):
    with pytest.raises(Exception, match="no canonical form"):
        canonical.digest(spark.createDataFrame([(float("nan"),)], "x double"))


@pytest.mark.parametrize("leaf", [4, 10_000])
def test_comparison_names_the_cells_that_differ(spark, tmp_path, monkeypatch, leaf):
    monkeypatch.setattr(canonical, "LEAF", leaf)
    old, new = [list(x) for x in rows()], [list(x) for x in rows()]
    new[17][1], new[400][2], new[401][3] = 7.5, "changed", (1, None)
    for x in new:
        x[-1] = "run 2"  # masked
    new.append([900, None, None, None, None, None, None, "run 2"])
    del new[5]
    old += [[7777, 1.0, str(k), None, None, None, None, ""] for k in range(3)]  # a repeated key
    new += [[7777, 1.0, str(k), None, None, None, None, ""] for k in (0, 2, 2)]
    for name, data in (("a", old), ("b", new)):
        canonical.write_run(spark.createDataFrame(data, SCHEMA), str(tmp_path / name), ["id"], ("started",), {"seed": 1, "run_id": name, "B": 2000 if name == "a" else 400})
    got = {(json.loads(x["key"])["id"], x["column"]): (x["before"], x["after"]) for x in canonical.compare(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    want = {(17, "x"): (repr(old[17][1]) if old[17][1] is not None else "null", "7.5"), (400, "name"): (canonical.canonical_json(old[400][2]), '"changed"'), (401, "part"): ('{"a":[0.5,null],"b":401}', '{"a":null,"b":1}'), (7777, "name"): ('"1"', '"2"')}
    assert {k: v for k, v in got.items() if k[0] not in (5, 900)} == want
    assert {k[1] for k in got if k[0] == 900} == {k[1] for k in got if k[0] == 5} == {"x", "name", "part", "day", "cost", "raw"}
    a, b = (canonical.manifest(spark, str(tmp_path / n)) for n in "ab")
    assert [x[0] for x in canonical.manifest_differences(a, b)] == ["B", "digest", "entries"]
    assert canonical.compare(spark, str(tmp_path / "a"), str(tmp_path / "a")).count() == 0
    if leaf == 4:
        nodes, depth = canonical.differing_leaves(spark, str(tmp_path / "a"), str(tmp_path / "b"))
        assert depth == 2 and 0 < nodes.count() <= 12  # of 256


def test_many_differing_leaves_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(canonical, "LEAF", 4)
    monkeypatch.setattr(canonical, "LISTED", 3)
    for name, step in (("a", 0), ("b", 1)):
        canonical.write_run(spark.range(500).select("id", (F.col("id") + step).alias("v")), str(tmp_path / name), ["id"])
    assert canonical.compare(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 500
