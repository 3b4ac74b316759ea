"""A key of a test set: equal rows in equal order give equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digests that one group joins.
FAN = 4096


def test_set_key(rows: DataFrame, position: str, cells: list[Column], count: int) -> DataFrame:
    """n and key: SHA-256 over the rows' texts in order, folded as a tree of ``FAN`` digests a node.

    ``position`` counts the rows from 0 without gaps and ``count`` is their number; null cells differ from
    empty ones.  No rows: n 0 and the digest of an empty text.
    """
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells])
    level = rows.select(F.col(position).alias("at"), F.sha2(text, 256).alias("digest"))
    size = count
    while size > 1:
        level = level.groupBy(F.floor(F.col("at") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("all"))
        level = level.select(F.col("up").alias("at"), F.sha2(F.concat_ws("", F.col("all.digest")), 256).alias("digest"))
        size = -(-size // FAN)
    return level.agg(F.lit(count).cast("long").alias("n"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("key"))
