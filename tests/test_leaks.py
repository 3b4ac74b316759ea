"""The leak scan against plain search in whole files, with needles planted across the borders of ranges."""

import base64
import random
from urllib.parse import quote, quote_plus

import pytest

from cohortlens.operators import leaks

NEEDLES = {"site": "St. Bärbel Klinik / Süd", "short": "S1", "line": "two\nlines here", "id": "patient-0042", "empty": ""}


def brute(data, needles):
    found = {}
    for name, needle in needles.items():
        for form, text in leaks.forms(needle).items() if needle else ():
            fold = len(needle) >= leaks.LONG and not form.startswith("base64")
            probes = {leaks.forms(x)[form].lower() for x in (needle, needle.lower(), needle.upper())} if fold else {text}
            hay = data.lower() if fold else data
            n = sum(hay.startswith(probe, k) for probe in probes for k in range(len(hay)))
            if n:
                found[name, form] = n
    return found


@pytest.mark.parametrize("size", [11, 50, 100_000])
def test_leaks_equal_a_search_in_whole_files(spark, tmp_path, size):
    r = random.Random(size)
    plain = lambda n: "".join(r.choice("abcdefgh ,:{}\n") for _ in range(n)).encode()
    files = {}
    for f in range(3):
        data = plain(90)
        for needle in NEEDLES.values():
            raw = needle.encode()
            for text in (raw, needle.upper().encode(), quote(needle).encode(), quote_plus(needle).encode(), *(base64.b64encode(b"x" * k + raw + b"yy") for k in range(3))):
                if r.random() < 0.6:
                    data += text + plain(r.randrange(40))
        files[f"f{f}.txt"] = data + b"\n"
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for n, v in zip(names, (str(size), "0", "1"), strict=True):
        spark.conf.set(n, v)
    try:
        needles = spark.createDataFrame(list(NEEDLES.items()), "needle string, text string")
        got = {}
        for x in leaks.scan(spark, str(tmp_path), needles).collect():
            got.setdefault(x["payload"].rsplit("/", 1)[1], {})[x["needle"], x["form"]] = x["hits"]
    finally:
        for n in names:
            spark.conf.unset(n)
    assert got == {name: brute(data, NEEDLES) for name, data in files.items() if brute(data, NEEDLES)}
    assert sum(len(x) for x in got.values()) > 15


def test_clean_files_have_no_hits(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"site": "Site A", "n": 42, "hash": "' + "ab12" * 16 + '"}\n')
    needles = spark.createDataFrame([(k, v) for k, v in NEEDLES.items() if k != "short"], "needle string, text string")
    assert leaks.scan(spark, str(tmp_path), needles).count() == 0


def test_base64_forms_lie_in_any_longer_text():
    for before in range(7):
        for after in range(5):
            text = base64.b64encode(b"z" * before + b"patient-0042" + b"!" * after)
            assert any(v in text for k, v in leaks.forms("patient-0042").items() if k.startswith("base64_"))


def test_needles_are_bounded(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_text("x\n")
    monkeypatch.setattr(leaks, "NEEDLE_BYTES", 3)
    with pytest.raises(ValueError, match="needles"):
        leaks.scan(spark, str(tmp_path), spark.createDataFrame([("a", "long one")], "needle string, text string"))
