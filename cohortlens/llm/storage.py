"""Cutting lineage with Parquet tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    A local master (tests) may leave it unset and gets a temporary folder; on a cluster that is an error,
    as executors would write where the driver and the others cannot read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{tempfile.gettempdir()}/cohortlens-checkpoints"
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Later stages restart from these files when an executor is lost, and read only the columns
    they name.  ``unpin`` or ``release`` removes the files; what is left goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pin-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop, files = _file_system(spark, path)
    files.deleteOnExit(hadoop)
    _made.append(path)
    scan = spark.read.schema(df.schema).parquet(path)
    scan._pinned_at = path
    return scan


def unpin(*scans: DataFrame) -> None:
    """Remove the files of pins that nothing will read again; other DataFrames are left alone."""
    for scan in scans:
        path = getattr(scan, "_pinned_at", None)
        if path in _made:
            _remove(scan.sparkSession, path)


def mark() -> int:
    """A point from which ``release`` counts."""
    return len(_made)


def release(since: int, keep: DataFrame) -> None:
    """Remove all pins made since ``mark`` but ``keep``, which no longer needs them."""
    for path in _made[since:]:
        if path != getattr(keep, "_pinned_at", None):
            _remove(keep.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    _made.remove(path)
    hadoop, files = _file_system(spark, path)
    files.delete(hadoop, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
