"""Seeded cohorts of any size: every cell is a hash of the seed, its column and its row, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import intervals as ci


def uniform(seed: int, name: str, row: Column) -> Column:
    """A number in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), row), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, name: str, row: Column) -> Column:
    radius = F.sqrt(-2 * F.log(uniform(seed, f"{name}/r", row)))
    return radius * F.cos(2 * math.pi * uniform(seed, f"{name}/a", row))


def make_cohort(spark: SparkSession, seed: int = 20240101, n: int = 400, prevalence: float = 0.3, separation: float = 1.5, sites: int = 3) -> DataFrame:
    """row_id, y_true, score, sex, age, site: scores are normal on the logit scale, positives ``separation`` higher."""
    row = F.col("id")
    d = spark.range(n).withColumn("y", (uniform(seed, "y", row) < prevalence).cast("int"))
    pick = lambda name, low, size: (F.lit(low) + F.floor(uniform(seed, name, row) * size)).cast("int")
    return d.select(
        F.format_string("r%06d", row).alias("row_id"),
        F.col("y").cast("string").alias("y_true"),
        F.round(ci.expit(normal(seed, "score", row) + separation * F.col("y") - separation / 2), 6).alias("score"),
        F.when(uniform(seed, "sex", row) < 0.5, "F").otherwise("M").alias("sex"),
        pick("age", 18, 77).alias("age"),
        F.concat(F.lit("S"), pick("site", 1, sites).cast("string")).alias("site"),
    )


def perturbed(cohort: DataFrame, seed: int = 20240101, shrink: float = 0.85, noise: float = 0.5) -> DataFrame:
    """The cohort with a weaker version's scores: logits shrunk and with noise that hangs on row_id."""
    return cohort.withColumn("score", F.round(ci.expit(shrink * ci.logit(F.col("score")) + noise * normal(seed, "prior", F.col("row_id"))), 6))
