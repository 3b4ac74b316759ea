"""Ranges of quoted CSV and of JSON lists against one-task parsers, at many sizes of ranges."""

import csv
import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.sources import ingest, splits


@pytest.fixture
def ranges(spark):
    """Sets the size of ranges for a test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield put
    for n, v in before.items():
        if v is None:
            spark.conf.unset(n)
        else:
            spark.conf.set(n, v)


def csv_rows(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [[x or None for x in r] for r in rows[1:] if any(c.strip() for c in r)]


TRICKY = 'id,"he\nad",z\r\n1,"a ""quoted"" x",2\n"line\nbreak\r\n,""",b"c,"d"\n,"",\n \n3,"' + "long\n" * 40 + '",é\n4,x "y" z,"tail\n"\n5,"",\n6,,"a"b"c\n'


@pytest.mark.parametrize("size", [16, 90, 100_000])
def test_csv_at_every_size_of_ranges(spark, tmp_path, ranges, size):
    r = random.Random(size)
    text = TRICKY
    for i in range(60):
        cells = ["".join(r.choice(['"', "\n", ",", "x", "é", " ", "\r\n"]) for _ in range(r.randrange(9))) for _ in range(3)]
        out = io.StringIO()
        csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow(cells)
        text += out.getvalue()
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    ranges(size)
    df = ingest.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "he\nad", "z"]
    assert sorted(map(str, (list(x) for x in df.collect()))) == sorted(map(str, csv_rows(text)))
    if size < 1000:
        assert df.rdd.getNumPartitions() > 3


def test_csv_of_several_files_and_refusals(spark, tmp_path, ranges):
    ranges(24)
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sorted(map(tuple, ingest.read_csv(spark, str(folder)).collect())) == sorted([("1", "x\ny"), ("2", "z")] * 3)
    (folder / "3.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ingest.InputError, match="other headers"):
        ingest.read_csv(spark, str(folder))
    (tmp_path / "wide.csv").write_text('a,b\n1,2\n3,"4\n",5\n')
    with pytest.raises(ingest.InputError, match="1 rows of another width"):
        ingest.read_csv(spark, str(tmp_path / "wide.csv"))
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\nto the end')
    assert [tuple(x) for x in ingest.read_csv(spark, str(tmp_path / "open.csv")).collect()] == [("1", "never closed\nto the end")]
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ingest.InputError, match="header"):
        ingest.read_csv(spark, str(tmp_path / "none.csv"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a,"\n', max_size=40))
def test_csv_state_equals_the_parser(text):
    """A record ends with a line exactly where the one-task parser ends a row."""
    inside, ends = False, []
    for line in text.split("\n"):
        inside, _ = splits.csv_line(line, inside)
        ends.append(not inside)
    rows = sum(ends[:-1]) + 1
    got = list(csv.reader(io.StringIO(text, newline="")))
    if not text.endswith("\n") or inside:
        assert len(got) == rows - (text == "")
    else:
        assert len(got) == rows - 1


@pytest.mark.parametrize("size", [40, 300])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_at_every_size_of_ranges(spark, tmp_path, ranges, size, indent):
    r = random.Random(3)
    odd = ['}"', "\\", '\\"}{', "[{", "é", "x" * 90, "", "\n", "]"]
    rows = [{k: r.choice([1, 2.5, 1e20, None, True, False, *odd]) for k in r.sample(["b", "a", "k}", 'q"\\'], r.randrange(1, 5))} for _ in range(50)]
    (tmp_path / "a.json").write_text("﻿" * 0 + json.dumps(rows, indent=indent, ensure_ascii=False))
    ranges(size)
    df = ingest.read_json(spark, str(tmp_path / "a.json"))
    names = list(dict.fromkeys(k for x in rows for k in x))
    assert df.columns == names
    want = [[splits._text(x.get(n)) for n in names] for x in rows]
    assert sorted(map(str, (list(x) for x in df.collect()))) == sorted(map(str, want))


def test_json_refusals(spark, tmp_path):
    for text in ("[]", "", '[{"a": 1}, 2]', '{"rows": 1}', '{"columns": 3}'):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(Exception, match="S04"):
            ingest.read_json(spark, str(tmp_path / "x.json"))
    (tmp_path / "y.json").write_text('[{" a ": 1, "b": {"c": [1, "}"]}}, {"a": 2}]')
    got = ingest.read_json(spark, str(tmp_path / "y.json"))
    assert got.columns == ["a", "b"] and [tuple(x) for x in got.collect()] == [(None, '{"c": [1, "}"]}'), ("2", None)]


def test_states_compose():
    row = lambda start, e0, e1, d=(0, 0), low=(0, None): {"file": "f", "start": start, "end0": e0, "end1": e1, "delta0": d[0], "delta1": d[1], "low0": low[0], "low1": low[1]}
    found = [row(20, True, False, low=(0, 0)), row(0, True, False), row(10, False, True)]
    begin, crossed = splits.beginnings(found, 1)
    assert begin == {("f", 0): (False, 1, 0), ("f", 10): (True, 1, 0), ("f", 20): (True, 1, 0)} and crossed
