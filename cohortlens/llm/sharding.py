"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a 60-bit hash of doc_id.  It starts with one bucket; a bucket
over the byte limit splits on the next bit, and only such a bucket, until every shard fits.  A bucket of one row
that is larger than the limit by itself stays, as does one whose rows share all 60 bits (rows that repeat a
doc_id); both show ``fits`` false.

Sizes are added up once by hash prefix, at ``STEP`` bits more than the total size needs.  From that table the
sums of shorter prefixes follow, ``STEP`` bits at a time, each table a part of the one before; a row takes the
shallowest prefix of its own that fits.  Rows whose prefix needs more bits are taken again, ``STEP`` bits deeper.

Null text counts 0 bytes; null doc_ids hash as an empty string; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import pin, shuffle_partitions

BITS, STEP = 60, 8


def hash_bits(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _fitting(bins: DataFrame, deep: int, start: int, limit: int) -> DataFrame:
    """bin (a prefix of ``deep`` bits) and s, its shallowest prefix of more than ``start`` bits (0 included) that fits, or null."""
    found = F.lit(None).cast("struct<shard_depth:int,shard_prefix:bigint,shard_bytes:bigint,shard_rows:bigint>")
    bins = bins.withColumn("top", F.shiftright("bin", deep - start))
    for depth in range(deep, start if start else -1, -1):  # the shallowest that fits comes last and wins
        at = f"p{depth}"
        bins = bins.withColumn(at, F.shiftright("bin", deep - depth))
        w = Window.partitionBy("top", at)
        bins = bins.withColumns({f"b{depth}": F.sum("b").over(w), f"r{depth}": F.sum("r").over(w)})
        fits = (F.col(f"b{depth}") <= limit) | (F.col(f"r{depth}") == 1) | F.lit(depth == BITS)
        value = F.struct(F.lit(depth).alias("shard_depth"), F.col(at).alias("shard_prefix"), F.col(f"b{depth}").alias("shard_bytes"), F.col(f"r{depth}").alias("shard_rows"))
        found = F.when(fits, value).otherwise(found)
    return bins.select("bin", found.alias("s"))


def _settled(rows: DataFrame, start: int, deep: int, limit: int) -> DataFrame:
    """bin (``deep`` bits) and s: the shallowest fitting prefix of more than ``start`` bits (0 included), or null."""
    bins = pin(rows.groupBy(F.shiftright("h", BITS - deep).alias("bin")).agg(F.sum("bytes").alias("b"), F.count("*").alias("r")))
    tables = []
    while True:
        above = max(start, deep - STEP)
        tables.append((deep, _fitting(bins, deep, above, limit)))
        if above == start:
            break
        bins = pin(bins.groupBy(F.shiftright("bin", deep - above).alias("bin")).agg(F.sum("b").alias("b"), F.sum("r").alias("r")))
        deep = above
    bits, out = tables[0]
    for shorter, table in tables[1:]:
        table = table.select(F.col("bin").alias("short"), F.col("s").alias("first"))
        out = out.join(table, F.shiftright("bin", bits - shorter) == F.col("short")).select("bin", F.coalesce("first", "s").alias("s"))
    return pin(out)


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """All rows and columns of ``docs`` (as ``doc``) with doc_id, shard_depth, shard_prefix (the leading bits),
    shard_bytes, shard_rows and fits."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), hash_bits(F.col("doc_id")).alias("h"), size.alias("bytes"))
    left = pin(rows.select("h", "bytes"))
    total = left.agg(F.sum("bytes")).first()[0] or 0
    start, deep, done = 0, min(BITS, math.ceil(math.log2(max(1, total / limit))) + STEP), None
    while True:
        bins = _settled(left, start, deep, limit)
        keyed = rows.withColumn("bin", F.shiftright("h", BITS - deep))
        out = keyed.join(bins.where("s is not null").select("bin", "s.*"), "bin")
        out = out.select("doc", "doc_id", "shard_depth", "shard_prefix", "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))
        done = out if done is None else done.unionByName(out)
        unsettled = bins.where("s is null").select("bin")
        if deep == BITS or unsettled.isEmpty():
            return done
        left = pin(left.withColumn("bin", F.shiftright("h", BITS - deep)).join(unsettled, "bin", "left_semi").drop("bin"))
        start, deep = deep, min(BITS, deep + STEP)


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """The rows of ``docs`` as Parquet, one folder per shard (``shard=<depth>-<prefix>``), one file in most."""
    rows = shard(docs, limit).select("doc.*", F.concat_ws("-", "shard_depth", "shard_prefix").alias("shard"))
    rows.repartition(shuffle_partitions(docs.sparkSession), "shard").write.partitionBy("shard").parquet(path)


def oracle_sql(limit: int) -> str:
    """DuckDB SQL of the same splits, to a depth of three times STEP bits."""
    depths = range(3 * STEP + 1)
    sums = ", ".join(f"sum(bytes) over (partition by h >> {60 - k}) as b{k}, count(*) over (partition by h >> {60 - k}) as r{k}" for k in depths)
    case = lambda what: "case " + " ".join(f"when b{k} <= {limit} or r{k} = 1 then {what(k)}" for k in depths) + " end"
    return f"""
with t as (select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h, coalesce(strlen(text), 0)::bigint as bytes from documents),
s as (select doc_id, h, {sums} from t)
select doc_id, {case(lambda k: f"{k}::int")} as shard_depth, {case(lambda k: f"h >> {60 - k}")} as shard_prefix,
       {case(lambda k: f"b{k}::bigint")} as shard_bytes, {case(lambda k: f"r{k}::bigint")} as shard_rows, {case(lambda k: f"b{k} <= {limit}")} as fits
from s
"""
