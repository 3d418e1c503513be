"""Merging pages by title, batch digests, sampling, debouncing and task views."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def merge_pages(pages: DataFrame) -> DataFrame:
    """key, id, title, page, ids for ``pages`` (title, page, ids, ord) grouped by normalised title.

    The longest page stays, the first of equally long ones; ids keep their first order, once each.
    """
    keyed = pages.withColumn("key", T.normalize_title("title"))
    best = keyed.groupBy("key").agg(F.max_by(F.struct("title", "page"), F.struct(F.length("page"), -F.col("ord"))).alias("r"), F.min("ord").alias("first_ord"))
    one = keyed.select("key", "ord", F.posexplode("ids").alias("pos", "x")).groupBy("key", "x").agg(F.min(F.struct("ord", "pos")).alias("at"))
    ids = one.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("ids"))
    return best.join(ids, "key", "left").select("key", T.uuid5("key").alias("id"), "r.title", "r.page", "ids", "first_ord")


def batch_digest(rows: DataFrame, group: str) -> DataFrame:
    """group, entries, batches, with_entries, reduce for ``rows`` (group, batch, id); rows without id have no entry."""
    g = rows.groupBy(group).agg(F.count("id").alias("entries"), F.count_distinct("batch").alias("batches"), F.count_distinct(F.when(F.col("id").isNotNull(), F.col("batch"))).alias("with_entries"))
    return g.withColumn("reduce", (F.col("batches") >= 2) & (F.col("with_entries") >= 2))


def sample_compilations(compilations: DataFrame, traceable: DataFrame, n: int, folder: str | None = None, seed: int | None = None) -> DataFrame:
    """At most ``n`` fresh, traceable compilations: the newest, or with a seed those of the smallest seeded hash."""
    c = compilations.filter("NOT stale")
    if folder is not None:
        c = c.filter(F.col("output_path").startswith(f"wiki/{folder}/"))
    c = c.join(traceable.select("id").distinct(), "id", "left_semi")
    order = [F.desc("compiled_at"), F.col("id")] if seed is None else [F.xxhash64("id", F.lit(seed)), F.col("id")]
    return c.orderBy(*order).limit(n)


def debounce(events: DataFrame, window_ms: int, key: str = "user_id") -> DataFrame:
    """Each event with whether it is accepted: at least ``window_ms`` after the last accepted one of its key.

    Acceptance depends on earlier acceptance, so each key's events are folded in order; they pass
    by in sorted batches, so that a key of any size takes the memory of a batch.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            accepted = []
            for who, ms in zip(batch.column("key").to_pylist(), batch.column("ms").to_pylist(), strict=True):
                ok = last is None or who != own or ms - last >= window_ms
                accepted.append(ok)
                own, last = who, ms if ok else last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_())], names=["key", "event_id", "ms", "accepted"])

    rows = events.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), "ms")
    return rows.repartition("key").sortWithinPartitions("key", "ms", "event_id").mapInArrow(fold, "key long, event_id long, ms long, accepted boolean")


def status_counts(sources: DataFrame, tasks: DataFrame, kinds: tuple[str, ...], statuses: tuple[str, ...]) -> DataFrame:
    """what, name, n over fixed domains, zeros included; states outside them don't show."""
    spark = sources.sparkSession
    domain = spark.createDataFrame([("source", k) for k in kinds] + [("task", s) for s in statuses], "what string, name string")
    seen = sources.groupBy(F.lit("source").alias("what"), F.col("type").alias("name")).count().unionByName(tasks.groupBy(F.lit("task").alias("what"), F.col("status").alias("name")).count())
    return domain.join(seen, ["what", "name"], "left").select("what", "name", F.coalesce("count", F.lit(0).cast("bigint")).alias("n"))


def task_view(tasks: DataFrame, transitions: DataFrame, as_of: str) -> DataFrame:
    """id, status, age_hours (to a tenth), transitions of the task's own.

    Status pages show that total for every task, so both are given.
    """
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.to_timestamp("created_at"))) / 3600
    own = transitions.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    every = transitions.agg(F.count(F.lit(1)).alias("every"))
    return tasks.join(own, "id", "left").crossJoin(F.broadcast(every)).select("id", "status", (F.floor(age * 10 + 0.5) / 10).alias("age_hours"), F.coalesce("own", F.lit(0).cast("bigint")).alias("transitions"), F.col("every").alias("transitions_shown"))


def lint_summary(valid: DataFrame, stale: DataFrame, uncompiled: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row: pages valid and invalid, stale, uncompiled and orphaned, and the sum of issues."""
    v = valid.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))  # noqa: E731  one row each
    j = v.crossJoin(count(stale, "stale")).crossJoin(count(uncompiled, "uncompiled")).crossJoin(count(orphans, "orphans"))
    return j.withColumn("issues", F.col("invalid") + F.col("stale") + F.col("uncompiled") + F.col("orphans"))
