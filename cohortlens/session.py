"""Making this package importable where Python tasks run."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which the driver and all executors share; removed when the application
    ends.  A local master (tests) may leave the setting out."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{tempfile.gettempdir()}/cohortlens-checkpoints"
    path = f"{named.rstrip('/')}/out-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors once per application, unless PYTHONPATH has them."""
    home = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if sc.applicationId in _shipped or str(home.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    _shipped.add(sc.applicationId)
    target = Path(tempfile.mkdtemp()) / "cohortlens.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))
    return spark
