"""Exact dedup by content sort, with DataFrame functions only.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted; null counts as
empty.  Rows are range-partitioned by sampled splitters on the normalised text's first characters, its
hash and a salt, sorted externally by the whole normalised text, and adjacent equal texts form a run
(the window operator compares neighbours' whole keys).  Splitters are of bounded length, so sampling them
never sends whole texts to the driver, while equality is decided on whole texts.

The salt is 0 but for texts with more copies than a quarter of a partition's share of rows; their copies
are dealt by row number over several runs, which are then merged by digest.  There are at most four such texts a
partition, so the merged runs are broadcast within that proven bound.

Of equal texts the row with most code points in the original text stays, then the smallest doc_id.
A null doc_id counts as the largest.  Rows that repeat a doc_id keep one row each in ``exact_groups``; all of
them have ``kept`` when their doc_id is the one that stays.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import pin, shuffle_partitions

SPACES = r"[\x20\x09-\x0D]+"
#: Characters of the normalised text in a splitter.
SPLITTER = 24


def _runs(docs: DataFrame) -> DataFrame:
    """Runs of adjacent equal texts: every row (doc, doc_id, norm) with its run's best row, its size, whether the
    row leads its run, and whether the text's runs are still to be merged."""
    parts = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("points"), F.regexp_replace(text, SPACES, "").alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    most = max(1, docs.count() // (4 * parts))
    copies = rows.groupBy("h").agg(F.count("*").alias("copies"))
    hot = copies.where(F.col("copies") > most).withColumn("ways", (F.col("copies") / most).cast("long") + 1).drop("copies")
    rows = rows.join(F.broadcast(hot), "h", "left").withColumn("at", F.monotonically_increasing_id())  # at most total / most rows
    rows = rows.withColumn("salt", F.when(F.col("ways").isNull(), 0).otherwise(F.pmod(F.xxhash64("at"), F.col("ways"))))
    rows = rows.withColumn("head", F.substring("norm", 1, SPLITTER)).repartitionByRange(parts, "head", "h", "salt")
    order = [F.desc("points"), F.asc_nulls_last("doc_id"), F.asc("at")]
    run = Window.partitionBy("head", "h", "salt", "norm").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.struct((-F.first("points").over(run)).alias("less"), F.first(F.col("doc_id").isNull()).over(run).alias("none"), F.first("doc_id").over(run).alias("id"), F.first("at").over(run).alias("at"))
    leads = F.row_number().over(Window.partitionBy("head", "h", "salt", "norm").orderBy(*order)) == 1
    return rows.select("doc", "doc_id", "norm", best.alias("best"), F.count("*").over(run).alias("n"), leads.alias("top"), F.col("ways").isNotNull().alias("salted"))


def _merged(runs: DataFrame) -> DataFrame:
    """The best row and the size of each salted text (at most four a partition), to be broadcast."""
    return F.broadcast(runs.where("salted and top").groupBy("text_sha256").agg(F.min("best").alias("all_best"), F.sum("n").alias("all_n")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``; empty for an empty table."""
    runs = pin(_runs(docs).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "best", "n", "top", "salted"))
    out = runs.join(_merged(runs), "text_sha256", "left")
    keep = F.coalesce("all_best", "best").getField("id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: ``exact_groups``' choice, and one only where
    rows repeat its doc_id.  Rows without a doc_id are judged like others."""
    digest = F.when(F.col("salted"), F.sha2("norm", 256)).alias("text_sha256")
    tops = pin(_runs(docs).where("top").select("doc", digest, "best", "n", "top", "salted"))
    out = tops.join(_merged(tops), "text_sha256", "left")
    return out.where("all_best is null or all_best = best").select("doc.*")


ORACLE_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), g as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size
  from d window w as (partition by text_sha256 order by points desc, doc_id)
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""
