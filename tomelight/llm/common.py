"""Helpers that the text operators share: input shaping, scratch tables and block sizing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fill_cores
from ..storage import new_path, remove

#: A word is a run of anything but these six characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Memory of an executor, for each of its cores, that sizes of blocks and partitions are stated for.
USUAL_CORE_BYTES = 2e9
#: What a row counts as beside its text, so that rows of empty texts spread like others.
ROW_BYTES = 64
#: Text bytes that a partition of dealt blocks holds, for the usual memory.
DEALT_BYTES = 16e6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; a null text becomes the empty one, other columns go."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def store(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``store`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_stored_at", None)
    if path:
        remove(df.sparkSession, path)


def text_bytes(df: DataFrame, text_col: str = "text") -> float:
    """Bytes of text in ``df`` and ``ROW_BYTES`` for each row, counted in a scan of that column."""
    own = F.coalesce(F.octet_length(df[text_col].cast("string")).cast("long"), F.lit(0)) + ROW_BYTES
    return float(df.agg(F.sum(own)).first()[0] or 0)


def map_all_columns(df: DataFrame, text_col: str, f: Callable[[pa.RecordBatch, int], pa.RecordBatch]) -> DataFrame:
    """``df`` with ``f`` applied to its batches, given the place of ``text_col``, which is a string there.

    ``f`` keeps columns and types.  Columns are numbered on the way, so they may have any names.
    """
    at = df.columns.index(text_col)
    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    numbered = fill_cores(numbered.withColumn(f"c{at}", numbered[f"c{at}"].cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch, at)

    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)


def for_memory(df: DataFrame, n_bytes: float) -> float:
    """``n_bytes``, which suit an executor of ``USUAL_CORE_BYTES`` a core, raised in proportion to what a core has here."""
    conf = df.sparkSession.sparkContext.getConf()
    text, cores = conf.get("spark.executor.memory", "1g").strip().lower(), int(conf.get("spark.executor.cores", "1") or 1)
    number, unit = (text.rstrip("b")[:-1], text.rstrip("b")[-1]) if not text.rstrip("b")[-1].isdigit() else (text, "")
    size = float(number) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[unit]
    return n_bytes * max(1.0, size / max(cores, 1) / USUAL_CORE_BYTES)


def parts_for(n_bytes: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / each))


def dealt_parts(df: DataFrame, size: float, n_blocks: int) -> int:
    """Partitions in which to deal ``n_blocks`` blocks of ``size`` bytes of text; a task's share is bounded at any size."""
    return max(parts_for(size, for_memory(df, DEALT_BYTES)), min(n_blocks, 2 * df.sparkSession.sparkContext.defaultParallelism))


def spread(df: DataFrame, n: int, *keys: Column | str) -> Column:
    """A block number below ``n`` from a hash of ``keys``."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class Memo(dict):
    """Values by key, made on first use.  Holds two generations of at most ``size`` keys each."""

    def __init__(self, make, size: int, longest_key: int = 64):
        super().__init__()
        self.make, self.size, self.longest_key, self.old = make, size, longest_key, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if not isinstance(key, (str, bytes)) or len(key) <= self.longest_key:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
