"""Operators against brute force on small tables with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import bpe, chat_format, exact_dedup, graph, language_id, ngram_join, packing, quality_classifier, quality_rules, sharding, tokens, url_filter
from cohortlens.llm.graph import components
from cohortlens.llm.text import bitmap, shingles
from cohortlens.llm.tokens import FragmentCoder, WordEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n int, fp string, salt string, words string, g string"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y", "z", "w", "g") for i, t in rows], SCHEMA)


def sample_texts(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 5, 12, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = base[:]
            for _ in range(r.choice([0, 1, 2, 5])):
                if copy:
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append((" \n" if r.random() < 0.3 else " ").join(copy).replace("w1", "W1" if r.random() < 0.5 else "w1"))
    return list(enumerate([*texts, None, "", " \t\n", "ünï İ  x", "one two three four five " * 3000]))


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_shingles_match_word_windows():
    for i, t in sample_texts(3):
        assert len(shingles(t)) == len(brute_sets([(i, t)])[i])


@pytest.mark.parametrize("node", [512, 4])
def test_ngram_join_equals_brute_force(spark, monkeypatch, node):
    monkeypatch.setattr(ngram_join, "NODE", node)
    monkeypatch.setattr(ngram_join, "HOT", 2048 if node == 512 else 6)
    r = random.Random(5)
    family = ["f%d" % i for i in range(120)]
    rows = sample_texts(1)
    for k in range(30):  # a group of near copies larger than a node
        copy = family[:]
        for _ in range(2):
            copy[r.randrange(120)] = "x%d" % r.randrange(1000)
        rows.append((1000 + k, " ".join(copy)))
    sets = brute_sets(rows)
    want = brute_components(sets)
    got = {x["doc_id"]: x for x in ngram_join.link_components(table(spark, rows)).collect()}
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert {i: x["n_shingles"] for i, x in got.items()} == {i: len(s) for i, s in sets.items()}


def test_ngram_join_edges(spark):
    assert ngram_join.link_components(table(spark, [])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b C d e f"), (None, "a b c d e f"), (9, None)]
    got = sorted(((x["doc_id"], x["component_id"]) for x in ngram_join.link_components(table(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, None), (9, 9)], key=str)
    assert sorted(str(x["doc_id"]) for x in ngram_join.keep_one(table(spark, rows)).collect()) == ["3", "9"]  # a null doc_id is last


def test_ngram_join_keeps_the_texts_of_a_repeated_doc_id_apart(spark):
    a, b = ("%s%%d" % x for x in "ab")
    base = {x: " ".join(x % i for i in range(30)) for x in (a, b)}
    rows = [(5, base[a]), (5, base[b]), (7, base[b] + " more"), (4, base[a] + " other"), (9, base[b])]
    got = sorted((x["doc_id"], x["component_id"], x["class_id"], x["n_links"]) for x in ngram_join.link_components(table(spark, rows)).collect())
    assert got == [(4, 4, 4, 1), (5, 4, 5, 1), (5, 5, 5, 1), (7, 5, 7, 1), (9, 5, 5, 1)]
    assert sorted(map(tuple, ngram_join.link_pairs(table(spark, rows)).collect())) == [(4, 5, 26), (5, 7, 26)]


def test_ngram_join_parts_thue_morse_texts(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} x"), (4, f"{other} x"), (5, word[:70]), (6, other[:70])]
    got = {x["doc_id"]: (x["component_id"], x["class_id"]) for x in ngram_join.link_components(table(spark, rows)).collect()}
    assert got == {i: (i, i) for i in range(1, 7)}


@pytest.mark.parametrize(("node", "cost"), [(512, 300_000), (4, 0)])
def test_ngram_join_counts_every_link(spark, monkeypatch, node, cost):
    monkeypatch.setattr(ngram_join, "NODE", node)
    monkeypatch.setattr(ngram_join, "PAIR_COST", cost)
    r = random.Random(7)
    rows = sample_texts(3, 20)
    for k in range(40):  # near copies of several lengths: far more links than a spanning tree has
        copy = ["f%d" % i for i in range(100 + k)]
        copy[r.randrange(100)] = "x%d" % k
        rows.append((1000 + k, " ".join(copy)))
    rows += [(2000, rows[-1][1]), (2001, rows[-1][1].upper()), (None, rows[-1][1])]
    sets = brute_sets(rows)
    classes = {}
    for i, s in sets.items():
        if s and i is not None:
            classes.setdefault(frozenset(s), i)
    links = {(a, b): len(x & y) for (x, a), (y, b) in itertools.combinations(classes.items(), 2) if 100 * len(x & y) >= 80 * len(x | y)}
    count = {a: sum(a in pair for pair in links) for a in classes.values()}
    class_of = {i: classes[frozenset(s)] if s and i is not None else i for i, s in sets.items()}
    assert max(count.values()) > 10
    got = {x["doc_id"]: x for x in ngram_join.link_components(table(spark, rows)).collect()}
    assert {i: x["class_id"] for i, x in got.items()} == class_of
    assert {i: x["n_links"] for i, x in got.items()} == {i: count.get(c, 0) if sets[i] and i is not None else 0 for i, c in class_of.items()}
    assert sorted(map(tuple, ngram_join.link_pairs(table(spark, rows)).collect())) == sorted((min(p), max(p), n) for p, n in links.items())


def test_tree_prunes_no_link():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, 80, dtype=np.uint64)
        for k in (0, 4, 9, 14):
            x = base.copy()
            x[:k] = r.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(x))
    links = ngram_join.tree_links(list(range(160)), [len(x) for x in sets], [bitmap(x) for x in sets], 80, sets)
    parent = list(range(160))
    for a, b in links:
        for i in range(160):
            if parent[i] == parent[a] and parent[a] != parent[b]:
                pass
        old, new = parent[a], parent[b]
        parent = [new if p == old else p for p in parent]
    want = brute_components({i: set(x.tolist()) for i, x in enumerate(sets)})
    assert all((parent[a] == parent[b]) == (want[a] == want[b]) for a, b in itertools.combinations(range(160), 2))


@pytest.mark.parametrize("parts", [1, 40])
def test_components(spark, monkeypatch, parts):
    monkeypatch.setattr(graph, "shuffle_partitions", lambda _: parts)  # of many partitions a hub's links are dealt
    edges = [(i, i + 1) for i in range(20, 60)] + [(5, 5), (3, 9), (9, 3), (100, 3)] + [(300, i) for i in range(301, 360)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 20 for i in range(20, 61)}, 3: 3, 9: 3, 100: 3, **{i: 300 for i in range(300, 360)}}


def test_exact_groups_equal_brute_force(spark):
    rows = sample_texts(2) + [(500 + i, "hot text" if i % 3 else "hot  text") for i in range(90)] + [(7, "dup"), (7, "dup"), (None, "hot text")]
    got = sorted((str(x["doc_id"]), x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) for x in exact_dedup.exact_groups(table(spark, rows)).collect())
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((str(i), keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    assert got == sorted(want)
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    assert exact_dedup.drop_copies(table(spark, rows)).columns == table(spark, rows).columns


def test_quality_rules_equal_brute_force(spark):
    rows = sample_texts(4) + [(900, "a b c d e a b c d e\nx y\nx y\n \n\nx y"), (901, "# * $ a|b <c> " * 9), (902, "aa bb cc dd ee " * 2 + "ff")]
    for x in quality_rules.quality_table(table(spark, rows)).collect():
        text = dict(rows)[x["doc_id"]] or ""
        w = WORDS.findall(text)
        lines = [y for y in text.split("\n") if WORDS.search(y)]
        where = {}
        for k in range(len(w) - 4):
            where.setdefault(tuple(w[k : k + 5]), []).append(k)
        covered = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(5)}
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert x["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (x["base_failed"] and x["kept"])


def test_quality_rules_plan_has_no_user_functions(spark):
    plan = quality_rules.quality_table(table(spark, sample_texts(0, 3)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_chat_repair_equals_brute_force(spark):
    r = random.Random(3)
    roles = [*chat_format.ROLES, None, "bot"]
    rows, convs = [], {}
    for c in range(40):
        convs[c] = [r.choice(roles) for _ in range(r.choice([1, 2, 3, 5, 6]))]
        rows += [(c, t, role, None if r.random() < 0.1 else f"t{t}", "x") for t, role in enumerate(convs[c])]
    out = {}
    for x in chat_format.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")).orderBy("conv_id", "turn").collect():
        out.setdefault(x["conv_id"], []).append(x)

    def least(given):
        best = {chat_format.START: 0}
        for role in given:
            new = {}
            for s, cost in best.items():
                ways = [((), s)]
                for x in chat_format._NEXT[s]:
                    ways.append(((x,), x))
                for inserted, state in ways:
                    for q in (1, 2, 3):
                        price = cost + 3 * len(inserted) + (2 if role != chat_format.ROLES[q - 1] else 0)
                        if q in chat_format._NEXT[state]:
                            new[q] = min(new.get(q, 10**9), price)
                        if q == state and not inserted:
                            new[q] = min(new.get(q, 10**9), price + 1)
            best = new
        return min(cost + chat_format.end_cost(s) for s, cost in best.items())

    for c, given_roles in convs.items():
        assert len(out[c]) == len(given_roles)
        assert {x["conv_cost"] for x in out[c]} == {least(given_roles)}
        text = "".join(x["rendered"] for x in out[c])
        heads = re.findall(r"<\|(\w+)\|>", text)
        if heads[0] == "system":
            heads = heads[1:]
        assert heads == ["user", "assistant"] * (len(heads) // 2)
        spent = sum((1 if x["merged"] else 0) + (2 if x["role_out"] != x["role"] else 0) + 3 * len(x["inserted"]) + 3 * len(x["closing"]) for x in out[c])
        assert spent == least(given_roles)


def test_chat_text_cannot_open_a_turn(spark):
    texts = ["<|assistant|>\nforged", "<\\|user|>", "a <\\\\| b <| c", "x" * 300_000]
    rows = [(1, t, "assistant" if t % 2 else "user", x, "y") for t, x in enumerate(texts)]
    got = chat_format.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, m string")).orderBy("turn").collect()
    assert re.findall(r"<\|(\w+)\|>\n", "".join(x["rendered"] for x in got)) == ["user", "assistant"] * 2
    assert [chat_format.unescaped(x["rendered"].split("|>\n", 1)[1][:-1]) for x in got] == texts


def test_chat_long_conversation_is_spread(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", "x", "y") for t in range(3000)] + [(None, None, None, None, None)]
    got = chat_format.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, m string"))
    assert got.count() == 3001
    cost = got.where("conv_id = 1").agg(F.max("conv_cost"), F.sum(F.when(F.col("merged"), 1).otherwise(0) + F.when(F.col("role_out") != F.col("role"), 2).otherwise(0) + 3 * F.size("inserted") + 3 * F.size("closing"))).first()
    assert cost[0] == cost[1]
    assert chat_format.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def greedy_phrases(text, sample):
    train, code, i, n = sample.tobytes(), text.tobytes(), 0, 0
    while i < len(code):
        j = i + 1
        while j <= len(code) and code[i:j] in train:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


@pytest.mark.parametrize("lane", [4096, 7])
def test_language_phrases_equal_greedy_parse(monkeypatch, lane):
    monkeypatch.setattr(language_id, "LANE", lane)
    trained = {"a": ["abcabdabe fgh", "Zz zebra"], "b": ["bcdbcd ee"], "c": ["слово 漢字仮名 漢名"]}
    model = language_id.Automata(trained)
    texts = ["abcabd abe zz", "", "!!", "bcdbcdbcd" * 60, "Ab", "漢字仮 Слово x字" * 9, "abcabdabe" * 40, "İß 1a"]
    coded = [language_id.letters(x) for x in texts]
    want = [[greedy_phrases(x, language_id.letters("\n".join(trained[k]))) for k in "abc"] for x in coded]
    assert model.phrases(coded).tolist() == want
    r = random.Random(2)
    coded = [language_id.letters("".join(r.choice("abcd ez") for _ in range(r.randrange(200)))) for _ in range(40)]
    want = [[greedy_phrases(x, language_id.letters("\n".join(trained[k]))) for k in "abc"] for x in coded]
    assert model.phrases(coded).tolist() == want


def test_language_id(spark):
    r = random.Random(1)
    syllables = {"xx": ["ka", "lo", "mi"], "yy": ["ber", "sch", "ung"]}
    rows = [(i, " ".join("".join(r.choice(syllables[g]) for _ in range(3)) for _ in range(40)), g, "s", 1, "", 1, "", "", "", "") for i in range(60) for g in ("xx" if i % 2 else "yy",)]
    rows += [(100, None, "xx", *rows[0][3:]), (101, "123 !!", "yy", *rows[0][3:]), (None, "kalomi", None, *rows[0][3:]), (102, "kalomi ka " * 60_000, None, *rows[0][3:])]
    got = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0
    assert got[None]["lang_pred"] == got[102]["lang_pred"] == "xx" and all(0 <= x["score"] <= 1 for x in got.values())
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items() if i is not None)
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_learns_from_bounded_texts(spark, monkeypatch):
    long = "kalomi lokami " * 370_000  # 5 MB and the only text of its language
    rows = [(i, long if i % 2 else "berschung ungber schber " * 30, "xx" if i % 2 else "yy", "s", 1, "", 1, "", "", "", "") for i in (1, 2)] + [(3, "lokami kalo", None, "s", 1, "", 1, "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = language_id.samples(docs, F.lit(True))
    assert {k: max(map(len, v)) for k, v in texts.items()} == {"xx": language_id.LONGEST, "yy": 720} and texts["xx"][0] in long
    assert {x["doc_id"]: x["lang_pred"] for x in language_id.predict(docs, texts).collect()} == {1: "xx", 2: "yy", 3: "xx"}
    monkeypatch.setattr(language_id, "LEARNED", 3200)
    assert {len(t) for v in language_id.samples(docs, F.lit(True)).values() for t in v} == {100}
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language_id.samples(docs, F.lit(True))


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right / n > 0.9


def test_url_filter(spark):
    pages = [
        (1, "https://www.A.Example.ORG/es/1?x"), (2, "http://example.org/en/12"), (3, "http://example.com/fr/"), (4, "http://b.com/de/3#x"), (5, "http://listed.net/a/"),
        (6, "https://www.listed.net/a?q"), (7, "http://listed.net/b"), (8, None), (9, "no scheme"), (10, "http://notexample.org/es/2"), (11, "http://example.com"), (5, "http://listed.net/a/"),
    ]
    pages = spark.createDataFrame([(*p, "h", "b", 1) for p in pages], "page_id long, url string, host string, block string, w0 int")
    listed = spark.createDataFrame([("listed.net/a",), (None,), ("listed.net/a",)], "url string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge(pages, listed).collect()}
    assert got == {
        1: ("www.a.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.com", "/fr/", "com/fr/", "allow"),
        4: ("b.com", "/de/3", "com/de/", "block"), 5: ("listed.net", "/a/", None, "block"), 6: ("www.listed.net", "/a", None, "block"), 7: ("listed.net", "/b", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("notexample.org", "/es/2", "org/", "allow"), 11: ("example.com", "", None, "allow"),
    }
    assert url_filter.judge(pages, listed.where("false")).where("listed").count() == 0


@pytest.mark.parametrize("most", [65_536, 4])
def test_url_filter_with_many_blocks_and_false_hits(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BITS_PER_URL", 1)  # a full filter, so that many URLs are let through to the join
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)
    listed = spark.range(3000).selectExpr("concat('l', id, '.net/a') as url")
    urls = [f"http://l{i}.net/a" for i in range(2000, 5000)] + ["http://l7.net/a/"] * 2000 + [None, "http://l8.net/b"]
    pages = spark.createDataFrame([(None if i % 50 == 0 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge(pages, listed)
    assert got.count() == len(urls)
    assert got.where("listed").count() == got.where("verdict = 'block'").count() == 1000 + 2000
    filtered = url_filter.bloom(listed, 1 << (3000 // 256).bit_length())
    assert filtered.count() == 16
    assert url_filter.judge(pages.where("false"), listed).count() == 0


def test_sharding(spark):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(1000, "y" * 5000), (None, None), (7, "x" * 300), (7, "x" * 300)]
    got = sharding.shard(table(spark, rows), 400).collect()
    assert len(got) == len(rows)
    shards = {}
    for x in got:
        shards.setdefault((x["shard_depth"], x["shard_prefix"]), []).append(x)
    for (depth, prefix), xs in shards.items():
        assert len(xs) == xs[0]["shard_rows"]
        assert xs[0]["fits"] == (xs[0]["shard_bytes"] <= 400)
        if not xs[0]["fits"]:
            assert len(xs) == 1 or depth == sharding.BITS
        for (d, p) in shards:
            assert (d, p) == (depth, prefix) or d < depth or (p >> (d - depth)) != prefix
    assert sum(xs[0]["shard_bytes"] for xs in shards.values()) == sum(len(t or "") for _, t in rows)
    assert sharding.shard(table(spark, []), 400).count() == 0


def test_sharding_starts_with_one_bucket_and_writes_shards(spark, tmp_path):
    rows = [(i, "x") for i in range(50)] + [(1000 + i, "y" * 900) for i in range(6)]  # a few rows hold most bytes
    docs = table(spark, rows)
    got = {(x["shard_depth"], x["shard_prefix"]): x for x in sharding.shard(docs, 1000).collect()}
    sizes = {i: len(t) for i, t in rows}
    bits = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in sizes}

    def split(depth, prefix, ids):
        size = sum(sizes[i] for i in ids)
        if size <= 1000 or len(ids) == 1:
            return {(depth, prefix): size} if ids else {}
        halves = ([i for i in ids if bits[i] >> (59 - depth) & 1 == b] for b in (0, 1))
        return {k: v for b, half in enumerate(halves) for k, v in split(depth + 1, 2 * prefix + b, half).items()}

    assert {k: x["shard_bytes"] for k, x in got.items()} == split(0, 0, list(sizes))
    assert [(x["shard_depth"], x["fits"]) for x in sharding.shard(docs, 10_000).collect()] == [(0, True)] * 56
    sharding.write_shards(docs, 1000, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.select("shard").distinct().count() == len(got) and back.drop("shard").columns == docs.columns and back.count() == 56


def test_packing(spark):
    rows = sample_texts(6) + [(3, "again"), (None, "none")]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = WordEncoder(path).whole
    docs = {}
    for i, t in rows:
        docs.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    got = packing.pack(table(spark, rows), path).collect()
    sequences = {}
    for x in got:
        assert any(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes() == x["ids"] and len(ids) == x["doc_tokens"] for ids in docs[x["doc_id"]])
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert sum(x["length"] for x in got) == sum(len(ids) for v in docs.values() for ids in v)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(table(spark, []), path).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4095), max_size=80))
def test_windows_hold_every_length(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    found = packing.windows(lengths)
    assert len(found) == len(lengths)
    if len(lengths):
        assert np.bincount(found, lengths).max() <= packing.CAPACITY


@pytest.mark.parametrize("lengths", [[1400], [2161], [3000], [513], [4000], range(2100, 2200), range(50, 600), range(1, 4096, 7)])
def test_packing_pads_little_at_any_lengths(lengths):
    lengths = np.resize(np.array(lengths, np.int64), packing.GROUP)
    owner, start, length, window, offset = packing._placed(lengths, packing.CAPACITY)
    sums = np.bincount(window, length)
    assert sums.max() <= packing.CAPACITY and sums.sum() == lengths.sum() and sums.sum() > 0.96 * packing.CAPACITY * len(sums)
    assert (np.bincount(owner, length) == lengths).all()
    for i in range(0, packing.GROUP, 37):  # a document's pieces, in order, are the document
        own = np.flatnonzero(owner == i)
        own = own[np.argsort(start[own])]
        assert (start[own] == np.cumsum(length[own]) - length[own]).all()
    for w in range(len(sums)):
        own = np.flatnonzero(window == w)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(length[own]) - length[own]).all()


def test_packing_equal_documents_pads_little(spark):
    rows = [(i, "word " * 2160) for i in range(300)]
    got = packing.pack(table(spark, rows), public_tokenizers.path("word_bpe_49k.json"))
    tokens_, sequences = got.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert tokens_ > 0.95 * 4096 * (sequences - 4)  # each of 4 partitions may end with a short one


def test_differencing_is_nearly_equal():
    lengths = np.random.default_rng(0).integers(1, 1000, 400)
    sums = np.bincount(packing.difference(lengths, 50), lengths, 50)
    assert sums.sum() == lengths.sum() and sums.max() - sums.min() <= 20


TRICKY = ["", "a", "'s it's I'll  ''s!'s", "  two   spaces \n\n x\r\n\ty", "<|endoftext|> a<|endoftext|>b <|endo", "é  b 　　x  y", "𝔘𝔫𝔦 😀😀  😀", "ß'll don't  \x1c\x1d \x85 z", "1234 5,6.7", "́a   q", "Größe, ça: niño!", "a" * 3000]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'sa é!<|>endoftx　😀1\x85", max_size=40)))
def test_fragments_encode_like_the_library(text):
    coder = FragmentCoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    text = text.encode("utf-8", "ignore").decode()
    ids = next(iter(coder.encode([text])))
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert coder.decode(ids) == coder.tokenizer.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'sa é!<|>startoftxend　😀1\x85İΣ́", max_size=40)))
def test_words_encode_like_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    encoder = WordEncoder.of(public_tokenizers.path("word_bpe_49k.json"))
    assert next(encoder.encode([text])).tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def test_words_encode_alike_in_small_slices(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = WordEncoder(path)
    monkeypatch.setattr(WordEncoder, "_bytes", 300)
    monkeypatch.setattr(tokens, "CACHE", 50)
    texts = [t for _, t in sample_texts(8)] + TRICKY
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe_digests(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = list(enumerate([*TRICKY, None])) + [(0, ""), (None, "x")]
    tokenizer = FragmentCoder.of(path).tokenizer
    got = sorted((str(x["doc_id"]), x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in bpe.digests(table(spark, rows), path).collect())
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(table(spark, rows), path), path).collect()
    assert sorted((str(x["doc_id"]), x["text"]) for x in back) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.digests(table(spark, []), path).count() == 0


def test_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn, judge = labels.where(F.pmod("doc_id", F.lit(3)) > 0), labels.where(F.pmod("doc_id", F.lit(3)) == 0)
    got = quality_classifier.classify(docs, learn)
    assert got.count() == docs.count()
    right = {(r["quality"], r["kept"]): r["count"] for r in got.join(judge, "doc_id").groupBy("quality", "kept").count().collect()}
    assert right.get((1, True), 0) > 0.99 * (right.get((1, True), 0) + right.get((1, False), 0))
    assert right.get((0, False), 0) > 0.9 * (right.get((0, True), 0) + right.get((0, False), 0))


def test_classifier_edges(spark):
    rows = table(spark, [(1, None), (2, ""), (None, "x y"), (2, "z"), (3, "long " * 30000)])
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert [x["kept"] for x in quality_classifier.classify(rows, labels).collect()] == [True] * 5
    assert quality_classifier.classify(table(spark, []), labels).count() == 0
