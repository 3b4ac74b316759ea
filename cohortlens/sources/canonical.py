"""Results as canonical JSON, their Merkle trees, and the comparison of two runs by descending their trees.

A row's canonical text is JSON with sorted keys, no spaces, numbers in their shortest form that reads back, times and
dates in ISO form, decimals and binary as text (plain, base64); NaN and infinities are refused.  Text and tree are those
of the rows alone: they do not depend on partitions, order of rows or order of columns.

A row's place in the tree is the SHA-256 of its text, so that no key or frequent row gathers; equal rows are one entry
with a count.  A node of depth d holds the entries that begin with its d hexadecimal digits; its digest is that of its
children's digits and digests, in order.  Leaves hold some ``LEAF`` entries.  A run is kept as rows in the order
of their places and as its tree, both Parquet; a comparison reads the two trees level by level, below the nodes that
differ only, and of the rows only the leaves that differ.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a leaf, about, and the digits of a place that name the leaves at most.
LEAF, DEEPEST = 256, 8
#: Differing leaves that are looked up by a pushed-down filter; more are joined.
LISTED = 500
#: Manifest keys that name a run and its time, and one that counts runs (fixed values): no part of a comparison.
VOLATILE, HISTORY = ("run_id", "started", "duration_s"), ("ledger_count",)


def _plain(value: object) -> object:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("NaN and infinities have no canonical form")
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return base64.b64encode(value).decode() if isinstance(value, (bytes, bytearray)) else value


def canonical_json(value: object, indent: int | None = None) -> str:
    """Sorted keys, fixed separators, no NaN; numbers as their shortest text."""
    return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False, allow_nan=False, indent=indent, separators=(",", ":") if indent is None else (",", ": "))


def with_text(rows: DataFrame, mask: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_text``, the canonical text of all columns but the masked ones, and ``_place``, its SHA-256."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_text", T.StringType())])
    names = [c for c in rows.columns if c not in mask]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in names]
            text = [canonical_json(dict(zip(names, cells, strict=True))) for cells in (zip(*columns, strict=True) if names else [()] * len(b))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "_text"])

    return rows.mapInArrow(write, schema).withColumn("_place", F.sha2(F.col("_text").cast("binary"), 256))


def write_lines(rows: DataFrame, path: str, order: list[str], parts: int | None = None) -> None:
    """Text files whose lines, file after file, are the rows' canonical texts by ``order``, then text: the same bytes
    at any number of files."""
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("_text")]
    text = with_text(rows)
    text = text.repartitionByRange(parts, *keys) if parts else text.repartitionByRange(*keys)
    text.sortWithinPartitions(*keys).select("_text").write.text(path)


def depth_for(entries: int) -> int:
    return min(DEEPEST, max(0, math.ceil(math.log(max(1, entries) / LEAF, 16))))


def tree(places: DataFrame, depth: int) -> DataFrame:
    """depth, node, digest and entries of every node, from (_place, n: rows there)."""
    level = places.select(F.substring("_place", 1, depth).alias("node"), F.col("_place").alias("part"), F.concat_ws(":", "_place", "n").alias("digest"), "n")
    levels = []
    for d in range(depth, -1, -1):
        parts = F.array_sort(F.collect_list(F.struct("part", "digest")))  # some LEAF entries, or 16 children
        level = level.groupBy("node").agg(F.sha2(F.concat_ws("\n", F.transform(parts, lambda x: x["digest"])).cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))
        levels.append(level.select(F.lit(d).alias("depth"), "node", "digest", F.col("n").alias("entries")))
        level = level.select(F.substring("node", 1, d - 1).alias("node") if d else F.lit("").alias("node"), F.col("node").alias("part"), F.concat_ws(":", "node", "digest").alias("digest"), "n")
    return reduce(DataFrame.unionByName, levels)


def digest(rows: DataFrame, mask: tuple[str, ...] = ()) -> str:
    """The root's digest: equal for equal rows, however they are dealt."""
    places = with_text(rows, mask).groupBy("_place").agg(F.count("*").alias("n"))
    root = tree(places, depth_for(places.count())).where("depth = 0").first()
    return root["digest"] if root else ""


def write_run(rows: DataFrame, path: str, keys: list[str], mask: tuple[str, ...] = (), facts: dict | None = None) -> dict:
    """Keep a run: rows by place, tree, and a manifest of ``facts`` (seed, versions, times, ...) with the root's digest."""
    spark = rows.sparkSession
    text = with_text(rows, mask)
    text.repartitionByRange("_place").sortWithinPartitions("_place").write.parquet(f"{path}/rows")
    places = spark.read.parquet(f"{path}/rows").groupBy("_place").agg(F.count("*").alias("n"))
    entries = places.count()
    tree(places, depth_for(entries)).repartitionByRange("depth", "node").sortWithinPartitions("depth", "node").write.parquet(f"{path}/tree")
    root = spark.read.parquet(f"{path}/tree").where("depth = 0").first()
    held = {**(facts or {}), "keys": keys, "masked": sorted(mask), "columns": sorted(rows.columns), "entries": entries, "leaf_depth": depth_for(entries), "rows": root["entries"] if root else 0, "digest": root["digest"] if root else ""}
    line = canonical_json(held)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return held


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def manifest_differences(a: dict, b: dict) -> list[tuple[str, str | None, str | None]]:
    """(key, before, after) of all keys whose values differ, but for those that name a run or count runs."""
    text = lambda held, k: canonical_json(held[k]) if k in held else None
    return [(k, text(a, k), text(b, k)) for k in sorted({*a, *b} - {*VOLATILE, *HISTORY}) if text(a, k) != text(b, k)]


def _below(nodes: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """Nodes of this depth under the parents; few parents become a filter that the scan takes."""
    listed = [r["node"] for r in parents.limit(LISTED + 1).collect()]
    level = nodes.where(F.col("depth") == depth)
    if len(listed) <= LISTED:
        cut = reduce(lambda x, y: x | y, [F.col("node").startswith(p) for p in listed]) if listed else F.lit(False)
        return level.where(cut)
    return level.join(parents.withColumnRenamed("node", "of"), F.substring("node", 1, depth - 1) == F.col("of"), "left_semi")


def differing_leaves(spark: SparkSession, first: str, second: str) -> tuple[DataFrame, int]:
    """Leaves (node) whose digests differ or that one run lacks, by descending both trees, and their depth."""
    depth = min(manifest(spark, p)["leaf_depth"] for p in (first, second))
    a, b = (spark.read.parquet(f"{p}/tree").select("depth", "node", "digest") for p in (first, second))
    nodes = None
    for d in range(depth + 1):
        x, y = ((_below(t, nodes, d) if d else t.where("depth = 0")).select("node", "digest") for t in (a, b))
        both = x.join(y.withColumnRenamed("digest", "other"), "node", "full_outer")
        nodes = both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("node")
        if d < depth and nodes.isEmpty():
            break
    return nodes, depth


def compare(spark: SparkSession, first: str, second: str) -> DataFrame:
    """key (canonical JSON of the key columns), column, before and after (canonical JSON; null: no such row) of every
    cell that differs; masked columns are left out.  A key's repeated rows are paired in the order of their texts."""
    held = [manifest(spark, p) for p in (first, second)]
    if (held[0]["keys"], held[0]["masked"]) != (held[1]["keys"], held[1]["masked"]):
        raise ValueError("the runs have other keys or masks")
    nodes, depth = differing_leaves(spark, first, second)
    listed = [r["node"] for r in nodes.limit(LISTED + 1).collect()]
    sides = []
    for path in (first, second):
        rows = spark.read.parquet(f"{path}/rows").select("_place", "_text")
        if len(listed) > LISTED:
            rows = rows.join(nodes, F.substring("_place", 1, depth) == F.col("node"), "left_semi")
        elif depth:
            rows = rows.where(reduce(lambda x, y: x | y, [F.col("_place").startswith(p) for p in listed]) if listed else F.lit(False))
        else:
            rows = rows if listed else rows.limit(0)
        sides.append(rows.groupBy("_text").agg(F.count("*").alias("n")))
    both = sides[0].join(sides[1].withColumnRenamed("n", "m"), "_text", "full_outer").select("_text", (F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("more")).where("more <> 0")
    both = both.select("_text", (F.col("more") > 0).alias("old"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more"))).alias("copy"))
    keys = held[0]["keys"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [json.loads(t, parse_float=_Number, parse_int=_Number) for t in b.column("_text").to_pylist()]
            key = ["{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_cell(r[k])}" for k in keys) + "}" for r in rows]
            cells = [[(c, _cell(v)) for c, v in r.items() if c not in keys] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), b.column("old"), b.column("_text"), b.column("copy"), pa.array(cells, pa.map_(pa.string(), pa.string()))], ["key", "old", "_text", "copy", "cells"])

    cut = both.select("_text", "old", "copy").mapInArrow(split, "key string, old boolean, _text string, copy long, cells map<string,string>")
    cut = cut.withColumn("at", F.row_number().over(Window.partitionBy("key", "old").orderBy("_text", "copy"))).select("key", "at", "old", "cells")
    a, b = cut.where("old").select("key", "at", F.col("cells").alias("was")), cut.where("not old").select("key", "at", F.col("cells").alias("is"))
    pairs = a.join(b, ["key", "at"], "full_outer").select("key", "was", "is", F.explode(F.array_union(F.coalesce(F.map_keys("was"), F.array().cast("array<string>")), F.coalesce(F.map_keys("is"), F.array().cast("array<string>")))).alias("column"))
    pairs = pairs.select("key", "column", F.col("was")[F.col("column")].alias("before"), F.col("is")[F.col("column")].alias("after"))
    return pairs.where(~F.col("before").eqNullSafe(F.col("after")))


class _Number(str):
    """A number as it is written."""


def _cell(value: object) -> str:
    """Canonical JSON of a cell read with ``_Number``."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_cell(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(_cell, value)) + "]" if isinstance(value, list) else json.dumps(value, ensure_ascii=False)
