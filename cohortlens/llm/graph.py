"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import pin, shuffle_partitions, unpin


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long); root is the smallest id reachable.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and a join, until the
    links no longer change.  The links of a hub are dealt by their other end.  Self links and repeated links are
    allowed; an empty table gives none.
    """
    now = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        most = max(1, 2 * state[0] // (4 * shuffle_partitions(edges.sparkSession)))  # a quarter of a partition's share
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.ceil(F.count("*") / most).alias("ways"))
        hubs = F.broadcast(least.where("ways > 1").select("a", "ways"))  # at most four a partition
        ends = both.where("b > a").join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("ways", F.lit(1))).alias("salt"))
        dealt = least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("salt"))
        large = ends.join(dealt, ["a", "salt"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, pin(linked.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        unpin(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
