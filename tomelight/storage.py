"""The folder that driver and executors share, and tables kept there while a session lasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession

_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        with suppress(Exception):
            option = spark.sparkContext._jsc.sc().getCheckpointDir()
            path = option.get() if option.isDefined() else None
    if not path:
        path = tempfile.mkdtemp(prefix="tomelight-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def listing(spark: SparkSession, path: str) -> int:
    """A hash of the files below ``path`` with their sizes and times, by whatever file system holds them."""
    system, target = _file_system(spark, path)
    files, found = system.listFiles(target, True), []
    while files.hasNext():
        f = files.next()
        found.append((str(f.getPath()), int(f.getLen()), int(f.getModificationTime())))
    return hash(tuple(sorted(found)))


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return bool(system.exists(target))


def remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):
        system, target = _file_system(spark, path)
        system.delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        with suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
