"""Session factory, and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``__`` for the dots."""
    builder = SparkSession.builder.appName("tomelight")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fill_cores(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it comes from fewer files than there are cores, and small ones; else as it is.

    A file may be one row group, which only one task can read.  Inputs that fill the cores with
    partitions of the usual size are never shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    usual = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * usual and 0 < len(df.inputFiles()) < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: Spark's file server hands them a zip of it, once."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="tomelight-"), "tomelight.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"tomelight/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
