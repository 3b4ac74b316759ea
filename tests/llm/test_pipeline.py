"""The five stages, each held to a brute-force version of itself on its own input, on a table where each decides."""

import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash

import corpus_pipeline
from cohortlens.llm import quality_classifier as qc
from cohortlens.llm import quality_rules, storage
from cohortlens.llm.tokens import WordEncoder
from tests.llm.test_operators import WORDS, brute_components, brute_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, kept boolean, row long, key string"
FEW = "the of and to in is that it was for river stone garden letter morning window music paper harbour winter".split()


def prose(r, n):
    return " ".join(r.choice(FEW) + ("." if r.random() < 0.1 else "") for _ in range(n))


def corpus():
    r = random.Random(11)
    rows, labels = [], []
    for i in range(260):
        good = i % 4 > 0
        text = prose(r, r.choice([12, 40, 90, 200])) if good else " ".join(r.choice(["###", "BUY", "$$$", "click", "%%", "0x77", "free"]) + r.choice("!*&") for _ in range(r.choice([12, 60])))
        rows.append((i, text, r.choice(["en", "de", None]), "web" if good else r.choice(["ads", "web"])))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    plain = [x for x in rows if x[0] % 4]
    for k in range(25):  # exact and near copies, some without doc_id, some that repeat one
        x = r.choice(plain)
        rows.append((1000 + k, x[1].replace(" ", "  ", 2), x[2], x[3]))
        words = x[1].split()
        words[-1] = "changed%d" % k
        rows.append((None if k % 5 == 0 else 2000 + k // 2, " ".join(words), x[2], x[3]))
    rows += [(7, rows[1][1], "en", "web"), rows[5], rows[5], (None, None, None, None), (3000, "", "en", "web"), (3001, None, "en", "web"), (None, "x y", "en", "web"), (3002, "SHOUTING " * 40, "en", "web"), (3003, "long " + prose(r, 30_000), "en", "web")]
    labels += [(0, 1, 0), (None, 1, 0), (9999, 0, 0), (4, None, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    rows, labels = corpus()
    spark.createDataFrame([(*x, len(x[1] or ""), "d", True, 5, "k") for x in rows], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    seen = [spark.read.parquet(f"{base}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(base)).write.parquet(f"{base}/{k}")
        seen.append(spark.read.parquet(f"{base}/{k}"))
    return seen, labels, str(base)


def content(df):
    return Counter((x["doc_id"], x["text"], x["lang"], x["source"]) for x in df.collect())


def cotrained(rows, labels):
    """Scores of each row's content by plain co-training over Python lists."""
    order = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)))[0]
    ids = {x[0] for x in rows}
    known = {}
    for i, q, _ in labels:
        if i is not None and i in ids and q in (0, 1):
            known[i] = min(q, known.get(i, 1))
    view = {x[1:]: (qc.text_features(x[1] or "").astype(float), qc.meta_features(x[2], x[3], x[1] or "").astype(float)) for x in rows}
    first = {x[0]: x[1:] for x in rows}
    sample = [i for y in (0, 1) for i in sorted((i for i in known if known[i] == y), key=lambda i: (order(i), i))]
    held = {i for y in (0, 1) for i in [j for j in sample if known[j] == y][:: qc.FOLDS]}
    teach = [[(view[first[i]][k], known[i], 1.0) for i in sample if i not in held] for k in (0, 1)]
    gold = [i for i in sample if i in held]
    fitted = lambda data: qc.fit(np.array([d[0] for d in data]), np.array([float(d[1]) for d in data]), np.array([d[2] for d in data]))
    taken, given = set(), []
    for done in range(qc.ROUNDS + 1):
        w = [fitted(teach[k]) for k in (0, 1)]
        odds = lambda x: [view[x][k] @ w[k][:-1] + w[k][-1] for k in (0, 1)]
        y = np.array([float(known[i]) for i in gold])
        platt = [qc.fit(np.array([[odds(first[i])[k]] for i in gold]), y, ridge=1e-2) for k in (0, 1)]
        p = lambda x: [1 / (1 + np.exp(-(o * c[0] + c[1]))) for o, c in zip(odds(x), platt, strict=True)]
        pool = {}
        for x in rows:
            if x[0] is not None and x[0] not in known and x[1:] not in taken:
                pool[x[1:]] = min(pool.get(x[1:], (10**20, 0)), (order(x[0]), x[0]))
        picks = []
        if done < qc.ROUNDS:
            for k in (0, 1):
                good = [x for x in pool if p(x)[k] >= qc.CONFIDENT and p(x)[1 - k] > 1 - qc.CONFIDENT]
                bad = [x for x in pool if p(x)[k] <= 1 - qc.CONFIDENT and p(x)[1 - k] < qc.CONFIDENT]
                picks += [(k, 1, x) for x in sorted(good, key=lambda x: (-odds(x)[k], pool[x]))[: qc.GIVEN]]
                picks += [(k, 0, x) for x in sorted(bad, key=lambda x: (odds(x)[k], pool[x]))[: qc.GIVEN]]
        if not picks:
            break
        assert len({x for _, y, x in picks if y} & {x for _, y, x in picks if not y}) == 0
        given.append(picks)
        for k, y, x in picks:
            teach[1 - k].append((view[x][1 - k], y, qc.PSEUDO))
        taken |= {x for _, _, x in picks}
    log = lambda x: np.array([o * c[0] + c[1] for o, c in zip(odds(x), platt, strict=True)])
    both = qc.fit(np.array([log(first[i]) for i in gold]), y, ridge=1e-2)
    return {x: 1 / (1 + np.exp(-(log(x) @ both[:-1] + both[-1]))) for x in view}, given


def test_classifier_stage(spark, stages, monkeypatch):
    monkeypatch.setattr(qc, "GIVEN", 20)
    seen, labels, base = stages
    rows = [(x["doc_id"], x["text"], x["lang"], x["source"]) for x in seen[0].collect()]
    # class weights are 1 as no label is left out of the sample
    score, given = cotrained(rows, labels)
    assert len(given) > 1 and sum(map(len, given)) > 20
    got = qc.classify(seen[0], spark.read.parquet(f"{base}/labels.parquet")).collect()
    assert len(got) == len(rows)
    assert np.allclose(sorted(x["score"] for x in got), sorted(score[x[1:]] for x in rows), atol=1e-6)
    kept = corpus_pipeline.classified(spark, seen[0], base)
    assert kept.columns == seen[0].columns
    assert content(kept) == Counter(x for x in rows if score[x[1:]] >= 0.5)
    assert 0 < sum(content(kept).values()) < len(rows)


def test_columns_and_decisions(stages):
    seen = stages[0]
    assert all(x.columns == seen[0].columns for x in seen[:-1])
    counts = [x.count() for x in seen[:-1]]
    assert all(a > b > 0 for a, b in zip(counts, counts[1:]))


def test_rules_stage(stages):
    want = Counter()
    for x, n in content(stages[0][1]).items():
        text = x[1] or ""
        w = WORDS.findall(text)
        lines = [y for y in text.split("\n") if WORDS.search(y)]
        where = {}
        for k in range(len(w) - 4):
            where.setdefault(tuple(w[k : k + 5]), []).append(k)
        covered = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(5)}
        chars = sum(map(len, w))
        figures = {
            "n_words": len(w), "symbols_per_100_words": len(re.findall(r"[#*$%&|<>]", text)) * 100 // max(1, len(w)), "capital_percent": len(regex.findall(r"\p{Lu}", text)) * 100 // max(1, chars),
            "stop_words_per_1000_words": sum(y in quality_rules.STOP_FORMS for y in w) * 1000 // max(1, len(w)), "mean_word_tenths": chars * 10 // max(1, len(w)), "dup_line_percent": (len(lines) - len(set(lines))) * 100 // max(1, len(lines)),
        }
        passes = all(len(w) < n or (lo is None or figures[f] >= lo) and (hi is None or figures[f] <= hi) for _, f, lo, hi, n in quality_rules.RULES)
        if passes and len(w) >= 10 and 100 * len(covered) <= 20 * len(w):
            want[x] = n
    assert content(stages[0][2]) == want


def test_exact_stage(stages):
    best = {}
    for x in content(stages[0][2]):
        key = re.sub("[\x20\x09-\x0d]", "", x[1] or "")
        best[key] = min(best.get(key, (1,)), (-len(x[1] or ""), x[0] is None, x[0] or 0))
    got = content(stages[0][3])
    assert Counter((-len(x[1] or ""), x[0] is None, x[0] or 0) for x in got.elements()) == Counter(best.values())


def test_near_stage(stages):
    rows = list(content(stages[0][3]).elements())
    root = brute_components(brute_sets(list(enumerate((x[1] for x in rows)))))
    best = {}
    for k, x in enumerate(rows):
        best[root[k]] = min(best.get(root[k], (True, 10**9, 0)), (x[0] is None, x[0] or 0, k))
    assert Counter(x[0] for x in content(stages[0][4]).elements()) == Counter(rows[k][0] for _, _, k in best.values())


def test_packing_stage_keeps_all(stages):
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json")).whole
    want = Counter((x["doc_id"], np.array([*encoder.encode(x["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for x in stages[0][4].collect())
    got, cut = Counter(), {}
    for x in stages[0][5].orderBy("doc_id", "start").collect():
        if x["doc_tokens"] <= 4096:
            got[x["doc_id"], x["ids"]] += 1
        else:
            cut.setdefault(x["doc_id"], []).append(x["ids"])
    assert len(cut) == 1
    assert got + Counter({(i, b"".join(v)): 1 for i, v in cut.items()}) == want


def test_empty_table(spark, stages):
    seen, _, base = stages
    docs = seen[0].where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, base).count() == 0


def test_run_removes_its_pins(spark, stages):
    since = storage.mark()
    got = corpus_pipeline.run(spark, stages[2])
    assert got.count() == stages[0][5].count()
    assert storage.mark() - since == 1  # the packing stage's input


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = conf = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
