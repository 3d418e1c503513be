"""Relations that are written to: versions of Parquet folders with unique keys.

A writer reads the newest version, writes the next one beside it and then makes that version's
marker, which can be made once.  A writer that finds its marker made by another starts again from
what that one wrote, so no change is lost; readers see whole versions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay readable behind the newest one.
KEPT_VERSIONS = 3


class NotUnique(ValueError):
    """Rows that share a key."""


class Contended(RuntimeError):
    """Other writers were faster each time."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The committed versions of the relation at ``path`` and their folders."""
    system, at = _files(spark, path)
    folder = at(f"{path}/_versions")
    if not system.exists(folder):
        return {}
    out = {}
    for f in system.listStatus(folder):
        name = f.getPath().getName()
        if name.isdigit() and f.getLen():
            stream = system.open(f.getPath())
            out[int(name)] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return out


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest version, or the given one; None where nothing was written."""
    have = versions(spark, path)
    if not have:
        return None
    return spark.read.parquet(f"{path}/{have[max(have) if version is None else version]}")


def _claim(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Make the marker of ``version``; False if it has been made."""
    from py4j.protocol import Py4JJavaError

    system, at = _files(spark, path)
    try:
        stream = system.create(at(f"{path}/_versions/{version:012d}"), False)
    except Py4JJavaError as e:
        if "already exists" in str(e.java_exception):
            return False
        raise
    stream.write(bytearray(folder.encode()))
    stream.close()
    return True


def write(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], unique: list[list[str]], tries: int = 8) -> int:
    """Commit what ``change`` makes of the newest version (None at first); the number of the new one.

    ``unique`` has the keys of which no two rows may share a value; a key with a null is free, as in
    relational tables.  NotUnique leaves the relation as it was.  ``change`` is called again for each
    new try, so it must go by its argument alone.
    """
    for _ in range(tries):
        have = versions(spark, path)
        before = max(have, default=0)
        folder = f"v-{uuid.uuid4().hex}"
        change(spark.read.parquet(f"{path}/{have[before]}") if have else None).write.parquet(f"{path}/{folder}")
        rows = spark.read.parquet(f"{path}/{folder}")
        system, at = _files(spark, path)
        for key in unique:
            twice = rows.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
            if twice:
                system.delete(at(f"{path}/{folder}"), True)
                raise NotUnique(f"{', '.join(key)}: {', '.join(str(twice[0][k]) for k in key)}")
        if _claim(spark, path, before + 1, folder):
            for old, name in have.items():
                if old <= before + 1 - KEPT_VERSIONS:
                    system.delete(at(f"{path}/_versions/{old:012d}"), False)
                    system.delete(at(f"{path}/{name}"), True)
            return before + 1
        system.delete(at(f"{path}/{folder}"), True)
    raise Contended(f"{path}: {tries} tries")


def insert(spark: SparkSession, path: str, rows: DataFrame, unique: list[list[str]], **kw) -> int:
    """Add ``rows``; NotUnique if a key is there or comes twice."""
    return write(spark, path, lambda now: rows if now is None else now.unionByName(rows), unique, **kw)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], order: str | None = None, **kw) -> int:
    """Put ``rows`` in place of those of their key; of rows that share one the last by ``order`` counts."""
    own = rows
    if order:
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
        own = last.select("r.*")

    def change(now: DataFrame | None) -> DataFrame:
        return own if now is None else now.join(own, key, "left_anti").select(*own.columns).unionByName(own)

    return write(spark, path, change, [key], **kw)


def delete(spark: SparkSession, path: str, keys: DataFrame, **kw) -> int:
    """Remove the rows whose key columns are among ``keys``."""

    def change(now: DataFrame | None) -> DataFrame:
        if now is None:
            raise ValueError(f"{path}: nothing was written")
        return now.join(keys, keys.columns, "left_anti").select(*now.columns)

    return write(spark, path, change, [], **kw)
