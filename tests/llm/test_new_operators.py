"""Toxicity, hard negatives and periodic runs against brute force, with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import hard_negatives, periodic_runs, queries, toxicity

WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, score double, runs string, lang string"
VECTORS = "vec_id long, embedding array<double>, label int, row string, tile string, v int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "r", "en") for i, t in rows], DOCS)


def brute_runs(w, least=12):
    """start, length, period of all runs, by looking at every period."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def listed(found):
    return [(s, e - s, q) for s, e, q in zip(*(x.tolist() for x in found), strict=True)]


words_ = st.one_of(st.lists(st.integers(0, 1), max_size=60), st.lists(st.integers(0, 3), max_size=60), st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12), st.lists(st.integers(0, 2), max_size=9)).map(lambda x: x[0] * x[1] + x[2]))


@settings(max_examples=150, deadline=None)
@given(words_, st.integers(1, 70), st.sampled_from([1, 12]))
def test_runs_do_not_depend_on_slabs(words, slab, least):
    catchers = periodic_runs.Catchers()
    for k in range(0, len(words), slab):
        catchers.append(np.array(words[k : k + slab], np.int64))
    assert listed(catchers.runs(least)) == brute_runs(words, least)


@settings(max_examples=40, deadline=None)
@given(st.lists(words_, max_size=8))
def test_runs_of_texts_in_one_stream(texts):
    got = periodic_runs.text_runs([np.array(w, np.int64) for w in texts])
    assert [listed(x) for x in got] == [brute_runs(w) for w in texts]


def test_runs_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_mix", lambda x: x & np.uint64(3))  # nearly all windows seem equal
    r = random.Random(4)
    for _ in range(30):
        w = [r.randrange(3) for _ in range(40)] + [7, 8, 9] * r.randrange(9)
        found = listed(periodic_runs.text_runs([np.array(w, np.int64)])[0])
        assert all(w[s : s + n - q] == w[s + q : s + n] for s, n, q in found)  # no false run


def test_thue_morse_has_squares_but_no_long_runs():
    w = [0]
    while len(w) < 4096:
        w += [1 - x for x in w]
    got = listed(periodic_runs.text_runs([np.array(w, np.int64)])[0])
    assert got and all(n < 3 * q for _, n, q in got)  # overlap-free: no exponent above 2
    assert listed(periodic_runs.text_runs([np.array(w[:600], np.int64)])[0]) == brute_runs(w[:600])


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    r = random.Random(1)
    texts = [None, "", " \n\t", "a " * 5000, "one two three " * 4 + "x", "A a b " * 9, "　 \x1c " * 8, "x y\nx y\r\n" * 6]
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(120))) for _ in range(100)]
    texts += [" ".join([r.choice("abc") for _ in range(r.randrange(1, 20))] * r.randrange(1, 9)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "p q " * 9), (None, "p q " * 9), (-3, "p q r s " * 9)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, (tuple(x) for x in queries.op13_periodic_runs(spark, str(tmp_path)).collect())))
    want, runs = [], 0
    for i, t in rows:
        w = WORDS.findall(t or "")
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if len(w) == 5000:
            found = [(0, 5000, 1)]
        else:
            found = brute_runs(w)
        runs += len(found)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join("%d,%d,%d\n" % x for x in found)
        want.append((i, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert runs > 100 and got == sorted(map(repr, want))
    assert periodic_runs.find(docs(spark, [])).count() == 0


def test_runs_of_one_long_text(spark):
    text = "alpha beta gamma " * 120_000 + "end"
    row = periodic_runs.find(docs(spark, [(1, text)])).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 360_000, 3)] and row["collapsed"] == "alpha beta gamma end"


def brute_negatives(rows, anchor=lambda i: i % 100 == 0, least=80, scale=256.0):
    good = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731 (the shorter one goes on with zeros)
    out = []
    for k, (i, v, y) in enumerate(good):
        if not anchor(i):
            continue
        scored = sorted((-dot(v, w), j, z == y) for m, (j, w, z) in enumerate(good) if m != k)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            window = [x for x in scored if not x[2] and least * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(window[:5], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "r", "t", 3) for i, v, y in rows], VECTORS)


@pytest.mark.parametrize(("cell", "block", "leaf"), [(1024, 8192, 64), (16, 2, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, cell, block, leaf):
    for name, value in (("CELL_LEAST", 16), ("CELL_MOST", cell), ("BLOCK", block), ("LEAF", leaf), ("SHARED", leaf)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = []
    for i in range(420):
        y = int(r.integers(4))
        v = centres[r.integers(6)] + 0.3 * r.normal(size=8)
        rows.append((i * 10, (v / np.linalg.norm(v)).tolist(), y))
    hot = rows[20][1]
    rows += [(5000 + i, hot, i % 4) for i in range(150)]  # one vector holds much of the table: all ties
    rows += [(100, hot, 1), (100, hot, 1), (100, rows[3][1], 2), (None, hot, 1), (7000, None, 1), (7100, hot, None), (7200, [None] + hot[1:], 1), (7300, [float("nan")] + hot[1:], 1)]
    rows += [(7400, [float("-inf")] + hot[1:], 1), (7500, [], 1), (7600, hot[:3], 2), (7700, [1e6] * 8, 3), (-100, hot, 0)]
    table = vectors(spark, rows)
    got = sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect()))
    assert len(got) > 200 and got == brute_negatives(rows)
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(table, F.lit(False)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 60), st.integers(1, 5), st.booleans())
def test_best_first_search_equals_a_full_scan(seed, n, dim, same):
    r = np.random.default_rng(seed)
    x, q = r.integers(-4, 5, (n, dim)), r.integers(-4, 5, (7, dim))
    ids, labels, rows = r.integers(0, 40, n), r.integers(0, 2, n), np.arange(n)
    low, high = r.integers(-30, 10, 7), r.integers(0, 40, 7)
    score, found = hard_negatives.search(x, ids, labels, rows, q, np.zeros(7, np.int64), np.arange(7), low, high, same, 3)
    for k in range(7):
        s = x @ q[k]
        want = sorted((-int(s[j]), int(ids[j])) for j in range(n) if (labels[j] == 0) == same and j != k and low[k] <= s[j] <= high[k])[:3]
        assert [(-a, b) for a, b in zip(score[k].tolist(), found[k].tolist()) if a > hard_negatives.NONE] == want


def test_box_intervals_hold_all_products():
    r = np.random.default_rng(0)
    x, q = r.integers(-50, 50, (40, 6)), r.integers(-50, 50, (9, 6))
    least, most = hard_negatives.interval(q, x.min(0)[None], x.max(0)[None])
    assert (least <= (q @ x.T).min(1)[:, None]).all() and (most >= (q @ x.T).max(1)[:, None]).all()


def bags(seed=0, n=400):
    r = random.Random(seed)
    plain = ["".join(r.choice("abdegiklmnorstu") for _ in range(5)) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        parts = [" ".join(r.choice(plain) for _ in range(8)) for _ in range(r.randrange(1, 12))]
        bad = r.random() < 0.2
        if bad:
            k = r.randrange(len(parts))
            parts[k] = " ".join([*parts[k].split()[:4], r.choice(["Vile", "foul", "NASTY"]), *parts[k].split()[4:]])
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_documents_and_sentences(spark):
    rows, labels = bags()
    long = "harmless words here. " * 20_000 + "a vile thing. " + "more. " * 10
    extra = [(900, None), (901, ""), (902, "?!"), (903, long), (None, "so foul a word"), (5, "quite another text"), (904, "x" * 50_000)]
    table = docs(spark, rows + extra)
    known = spark.createDataFrame([*labels, (900, 0, 1), (None, 0, 1), (903, 0, 0), (1, None, None), (2, 0, 7)], "doc_id long, quality int, toxic int")
    got = [x.asDict(recursive=True) for x in toxicity.classify(table, known).collect()]
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in labels}
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth and x["doc_id"] != 5]
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got)
    assert len(held) > 80 and sum(x["predicted"] == truth[x["doc_id"]] for x in held) / len(held) > 0.97
    text = dict(rows)
    for x in held:
        assert x["predicted"] == int(x["score"] >= 0.7) and 0 <= x["score"] <= 1
        for s in x["sentences"]:
            assert text[x["doc_id"]][s["start"] : s["end"]] == s["text"] and re.search("vile|foul|nasty", s["text"].lower())
    by = {x["doc_id"]: x for x in got if x["doc_id"] != 5}
    assert [by[i]["score"] for i in (900, 901, 902)] == [0, 0, 0] and by[None]["predicted"] == by[903]["predicted"] == 1 and by[904]["predicted"] == 0
    assert [s["text"] for s in by[903]["sentences"]] == [" a vile thing"]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert {x["score"] for x in toxicity.classify(docs(spark, [(1, "a b"), (2, "c"), (None, None)]), labels).collect()} == {0.0}
    assert toxicity.classify(docs(spark, []), labels).count() == 0


def test_noisy_or_likelihood_rises():
    """The fit's own objective: no step to the side of the result is better."""
    r = np.random.default_rng(2)
    word, owner = r.integers(0, 6, 300), np.repeat(np.arange(100), 3)
    bag = np.arange(0, 100, 4)
    y = np.array([int((word[12 * k : 12 * k + 12] == 0).any()) for k in range(25)])
    prior = np.zeros(6)
    w, b = toxicity.fit(word, owner, 100, bag, y, np.ones(25), prior)

    def loss(w, b):
        z = np.bincount(owner, w[word], 100) + b
        total = np.add.reduceat(np.logaddexp(0, z), bag)
        return np.where(y > 0, -np.log(-np.expm1(-total)), total).sum() + toxicity.RIDGE * ((w - prior) ** 2).sum() / 2

    at = loss(w, b)
    assert w[0] == w.max()
    for k in range(6):
        for step in (-0.5, 0.5):
            assert loss(w + step * (np.arange(6) == k), b) > at - 1e-2
    assert loss(w, b - 0.5) > at - 1e-2 and loss(w, b + 0.5) > at - 1e-2


def test_sentences_are_cut_after_many_words():
    text = "one two. " + "w " * 100 + "!\nlast"
    parts = list(toxicity.sentences(text))
    assert [len(w) for _, _, w in parts] == [2, 32, 32, 32, 4, 1]
    assert all(toxicity._WORD.findall(text[s:e]) == w for s, e, w in parts)
