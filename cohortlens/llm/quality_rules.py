"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every figure is a built-in expression over the whole text; repeated five-word windows are found by
sorting the hashes of a text's windows next to their positions, so the work is n log n in its words.
``compile_rules`` turns the table of thresholds into columns of that same projection.

Null and empty texts have no words: all counts are 0, ``base_failed`` is true and ``kept`` false.
Only ``doc_id`` and ``text`` are read; repeated rows each give their row; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
LINE_WITH_WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
#: Frequent short words of the languages that the corpus holds (fixed values); also counted with a capital first letter.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux dans de des du elle en est et il la le les ne pas pour que qui se sur un une "
    "al con del el es esta las los no para por su una y "
    "auf das dem den der die ein eine für ist mit nicht sie sich und von zu"
).split()
STOP_FORMS = sorted({y for x in STOP_WORDS for y in (x, x[0].upper() + x[1:])})

#: (name, figure, least, most, from_words): a document stays when every figure lies in its closed range; None is
#: open.  A rule judges documents of at least ``from_words`` words: a rate of stop words says nothing of a short text.
RULES = (
    ("length", "n_words", 10, None, 0),
    ("symbols", "symbols_per_100_words", None, 50, 0),
    ("shouting", "capital_percent", None, 60, 0),
    ("stop_words", "stop_words_per_1000_words", 10, None, 100),
    ("word_size", "mean_word_tenths", 15, 150, 0),
    ("duplicate_lines", "dup_line_percent", None, 40, 0),
)


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """Names a value inside one expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(words: Column) -> list[tuple[str, Column]]:
    """Steps of one projection whose last column, ``hashes``, has a hash of every five-word window, in order."""

    def joined(left: str, right: str, skip: int) -> Column:
        rest = F.slice(right, F.lit(skip + 1), F.greatest(F.size(right) - skip, F.lit(0)))
        return F.zip_with(left, rest, lambda x, y: F.xxhash64(x, y))

    return [
        ("one", F.transform(words, lambda w: F.xxhash64(w))),
        ("two", joined("one", "one", 1)),
        ("four", joined("two", "two", 2)),
        ("hashes", F.slice(joined("four", "one", WINDOW - 1), F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))),
    ]


def repeat_words(words: Column, hashes: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of ``width`` words found twice or more, the first one included.

    Only a text that has equal hashes sorts its windows; neighbours then compare their words.
    """
    at_words = lambda p: F.slice(words, p["at"] + 1, F.lit(width))

    def covered(at: Column) -> Column:
        gap = lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width)))
        return F.aggregate(F.transform(at, gap), F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(pairs: Column) -> Column:
        alike = lambda p, q: F.coalesce((p["h"] == q["h"]) & (at_words(p) == at_words(q)), F.lit(False))
        same = lambda p, i: alike(p, F.get(pairs, i - 1)) | alike(p, F.get(pairs, i + 1))
        return _let(F.sort_array(F.transform(F.filter(pairs, same), lambda p: p["at"])), covered)

    windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(F.sort_array(windows), repeated))


def compile_rules(rules: tuple) -> Column:
    """One boolean from the table of thresholds; figures are integers, so bounds are exact."""
    verdict = F.lit(True)
    for _, figure, least, most, from_words in rules:
        exempt = F.col("n_words") < from_words
        if least is not None:
            verdict = verdict & (exempt | (F.col(figure) >= least))
        if most is not None:
            verdict = verdict & (exempt | (F.col(figure) <= most))
    return verdict


def quality_table(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """doc_id, the base counts, the rules' figures (long), base_failed and kept."""
    return _judged(docs, rules).drop("doc")


def keep_good(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The rows that pass the rules, with all their columns; every row is judged by itself, null and repeated doc_ids too.

    A filter would be pushed into the projection with a copy of every figure's expression; the row number,
    which is not deterministic, keeps it above.
    """
    judged = _judged(docs, rules).select("doc", "kept", F.monotonically_increasing_id().alias("at"))
    return judged.where(F.col("kept") & (F.col("at") >= 0)).select("doc.*")


def _judged(docs: DataFrame, rules: tuple) -> DataFrame:
    """``quality_table`` with the whole row as ``doc``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(LINE_WITH_WORD))
    d = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    for name, step in window_hashes(F.col("words")):
        d = d.withColumn(name, step)
    joined = F.array_join("words", "")
    d = d.select(
        "doc",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(joined).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.col("hashes")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
    )
    per = lambda top, scale, below: F.floor(F.col(top) * scale / F.greatest(F.col(below), F.lit(1))).cast("long")
    d = d.withColumns(
        {
            "symbols_per_100_words": per("n_symbols", 100, "n_words"),
            "capital_percent": per("n_capitals", 100, "word_chars"),
            "stop_words_per_1000_words": per("n_stop_words", 1000, "n_words"),
            "mean_word_tenths": per("word_chars", 10, "n_words"),
            "dup_line_percent": per("n_dup_lines", 100, "n_lines"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    return d.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def oracle_sql(rules: tuple = RULES) -> str:
    """DuckDB SQL of the same table."""
    tests = [f"({f} >= {lo} or n_words < {n})" for _, f, lo, _, n in rules if lo is not None] + [f"({f} <= {hi} or n_words < {n})" for _, f, _, hi, n in rules if hi is not None]
    stops = ", ".join(f"'{x}'" for x in STOP_FORMS)
    return rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select doc_id, unnest(range(1, greatest(len(words) - 3, 1))) as i, words from w where len(words) >= 5),
h as (select doc_id, i, count(*) over (partition by doc_id, words[i:i+4]) as n from g),
c as (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as gap from h where n > 1),
r as (select doc_id, sum(gap)::bigint as n_repeat_words from c group by doc_id),
b as (select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
      (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
      len(lines)::bigint as n_lines, len(regexp_extract_all(text, '\p{{Lu}}'))::bigint as n_capitals,
      len(list_filter(words, lambda x: x in ({stops})))::bigint as n_stop_words
      from w left join r using (doc_id)),
f as (select *, (n_symbols * 100 // greatest(n_words, 1))::bigint as symbols_per_100_words,
      (n_capitals * 100 // greatest(word_chars, 1))::bigint as capital_percent,
      (n_stop_words * 1000 // greatest(n_words, 1))::bigint as stop_words_per_1000_words,
      (word_chars * 10 // greatest(n_words, 1))::bigint as mean_word_tenths,
      (n_dup_lines * 100 // greatest(n_lines, 1))::bigint as dup_line_percent,
      n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select *, not base_failed and {' and '.join(tests)} as kept from f
"""
