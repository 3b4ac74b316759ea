"""URL filters: domain rules, then a blocked Bloom filter of listed URLs backed by an exact hash join.

DataFrame functions only.  A URL's host lies between the first ``://`` and ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; its path runs on to ``?``, ``#`` or the end.  A rule (host, path) fits its host and all
subdomains when the path starts with the rule's; the longest fitting rule decides.  A URL without a rule is
blocked when its canonical form (host without a leading ``www.``, path without trailing slashes) is listed.

The list is written once.  The filter is a table of blocks of eight 32-bit words that grows with the list; up
to ``MOST_BLOCKS`` it is broadcast (a proven bound), beyond that URLs are joined with their block.  Possible hits
are joined with the list, whose keys are distinct.  In both joins a hot URL is dealt over ``SALTS`` parts by row
number.

A null URL and one without ``://`` have empty host and path, no rule, and are allowed.  Rows map one to
one; a null in the list is ignored; an empty list blocks nothing.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import pin

MOST_BLOCKS, WORDS, BITS_PER_URL, SALTS = 65_536, 8, 16, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (verdict, host, path): fixed values of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PATTERN, 1), UPPER, LOWER), F.regexp_extract(url, PATTERN, 2)


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def first_rule(rules: tuple, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one that fits wins
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _bits(url: Column) -> list[Column]:
    """One bit of each of the block's words."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(url, F.lit(i)), F.lit(32)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0 to w7 of the distinct column ``url``."""
    words = [x.alias(f"b{i}") for i, x in enumerate(_bits(F.col("url")))]
    rows = listed.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *words)
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and whether the URL is listed, of pages (page_id, url)."""
    listed = pin(listed.select(F.col("url").alias("url")).where("url is not null").distinct())
    blocks = 1 << (listed.count() * BITS_PER_URL // (32 * WORDS)).bit_length()
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = first_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "said": said, "url": canonical(F.col("host"), F.col("path")), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    rows = rows.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks)))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    if blocks <= MOST_BLOCKS:
        rows = rows.join(F.broadcast(bloom(listed, blocks)), "block", "left")
    else:
        rows = rows.join(bloom(listed, blocks).select("*", salts), ["block", "salt"], "left")
    in_all = F.lit(True)
    for i, bit in enumerate(_bits(F.col("url"))):
        in_all = in_all & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(bit) != 0)
    rows = rows.select("page_id", "host", "path", "rule", "said", "url", "salt", (in_all & (F.col("url") != "")).alias("possible"))
    possible = rows.where("possible").join(listed.select("url", salts, F.lit(True).alias("hit")), ["url", "salt"], "left")
    sure = rows.where("not possible").withColumn("hit", F.lit(None).cast("boolean"))
    columns = ["page_id", "host", "path", "rule", "said", F.coalesce("hit", F.lit(False)).alias("listed")]
    both = possible.select(*columns).unionByName(sure.select(*columns))
    return both.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: Runs of junk symbols in a page before its URL is listed.
JUNK = r"[#*$%&]{3}"
JUNK_LEAST = 30


def junk_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs (column url) that have served a page full of symbol runs."""
    host, path = host_and_path(F.col("url"))
    bad = pages.where(F.regexp_count("html", F.lit(JUNK)) >= JUNK_LEAST)
    return bad.select(canonical(host, path).alias("url")).where("url <> ''")


_HOST = rf"translate(regexp_extract(coalesce(url, ''), '{PATTERN}', 1), '{UPPER}', '{LOWER}')"
_PATH = rf"regexp_extract(coalesce(url, ''), '{PATTERN}', 2)"


def oracle_sql(rules: tuple = RULES) -> str:
    fits = [(w, h + p, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for w, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "case " + " ".join(f"when {f[2]} then '{f[k]}'" for f in fits) + " end"
    return rf"""
with p as (select page_id, html, {_HOST} as host, {_PATH} as path from pages),
c as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') as canon, {case(1)} as rule, {case(0)} as said from p),
l as (select distinct canon from c where canon <> '' and len(regexp_extract_all(html, '{JUNK}')) >= {JUNK_LEAST})
select page_id, host, path, rule, coalesce(said, case when l.canon is not null then 'block' else 'allow' end) as verdict, l.canon is not null as listed
from c left join l on c.canon = l.canon
"""
