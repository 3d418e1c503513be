"""Registering sources, change detection, upserts and scans with filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in ``order``, by partial aggregation rather than a window."""
    rank = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def latest_per_path(sources: DataFrame) -> DataFrame:
    """path, id, hash and time of its latest row; of rows of one time the last registered (the larger ``ord``) wins."""
    last = sources.groupBy("path").agg(F.max_by(F.struct("id", "hash", "ingested_at"), F.struct("ingested_at", F.col("ord"))).alias("r"))
    return last.select("path", "r.id", "r.hash", "r.ingested_at")


def source_changed(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """path, hash, changed for ``candidates``: true if the path is new or its latest hash differs."""
    latest = latest_per_path(sources).select("path", F.col("hash").alias("latest_hash"))
    return candidates.join(latest, "path", "left").select("path", "hash", (F.col("latest_hash").isNull() | (F.col("latest_hash") != F.col("hash"))).alias("changed"))


def register_source(sources: DataFrame) -> DataFrame:
    """Idempotent registration: the first row of each (path, hash)."""
    return first_per(sources, ["path", "hash"], "ingested_at", "ord")


def ingest_upsert(files: DataFrame, sources: DataFrame, most_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """path, hash, raw_dir, state of each file: too-large, unchanged, reingest or ingest."""
    latest = latest_per_path(sources).select("path", F.col("hash").alias("latest_hash"))
    state = F.when(F.col("n_bytes") > most_bytes, "too-large").when(F.col("latest_hash").isNull(), "ingest").when(F.col("latest_hash") == F.col("hash"), "unchanged").otherwise("reingest")
    raw_dir = F.when(F.col("type") == "pdf", "raw/papers").when(F.col("type") == "html", "raw/articles").otherwise("raw/notes")
    return files.join(latest, "path", "left").select("path", "hash", raw_dir.alias("raw_dir"), state.alias("state"))


def filtered(df: DataFrame, order: list[Column], limit: int | None = None, **equal: object) -> DataFrame:
    """Rows that equal every given value, in order, at most ``limit``."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def upsert(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Last write per key wins; what is written is no longer stale."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, "ord")).alias("_row"))
    return last.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest)).withColumn("stale", F.lit(False))


def validate_recall(rows: DataFrame) -> DataFrame:
    """Each row with its trimmed concept and a reject code or null."""
    concept = F.trim("concept")
    code = F.when(concept == "", "EMPTY_CONCEPT").when((F.col("confidence") < 0) | (F.col("confidence") > 1), "BAD_CONFIDENCE")
    return rows.withColumn("concept", concept).withColumn("reject", code)


def batches(df: DataFrame, order: str, size: int, group: str) -> DataFrame:
    """``batch`` number of each row within ``group``; a size of 0 or less makes one batch."""
    if size <= 0:
        return df.withColumn("batch", F.lit(0).cast("bigint"))
    return numbered(df, group, [order], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("bigint"))
