"""2 x 2 counts of a stream by event time (an extension: the batch operators have no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.counts import OperatingPoint


def windowed_counts(rows: DataFrame, point: OperatingPoint, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start and 2 x 2 counts per tumbling window of ``ts``; works on batches and, with a watermark, on streams."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    y, p = F.col("y") == 1, point.positive(F.col("score"))
    out = rows.groupBy(F.window("ts", width).alias("w")).agg(F.count_if(y & p).alias("tp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"))
    return out.select(F.col("w.start").alias("start"), "tp", "fn", "fp", "tn")
