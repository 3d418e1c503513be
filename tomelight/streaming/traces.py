"""Following append-only logs: an extension over the batch operators, with the same rules.

Readers take folders of day files.  Daily counts keep bounded state by a watermark; changed sources
go through the batch impact operator one micro-batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lineage import affected_set

EVENT = "event_id long, ts timestamp, user_id long, event_type string"


def follow_traces(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """Events of JSON lines as they are appended; unreadable lines are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).filter("trim(value) <> ''")
    return lines.select(F.from_json("value", schema).alias("e")).filter("e.event_id IS NOT NULL").select("e.*")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by UTC day and type; a day closes once the watermark passes it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once: redelivered lines within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def impact_sink(sources: DataFrame, compilations: DataFrame, junction: DataFrame, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: changes (path, hash) of a micro-batch to the pages they touch."""

    def batch(changes: DataFrame, batch_id: int) -> None:
        write(affected_set(changes.select("path", "hash").distinct(), sources, compilations, junction), batch_id)

    return batch


def debounced(events: DataFrame, window_ms: int, late: str = "1 hour") -> DataFrame:
    """key, event_id, ms, accepted of a stream of (key, event_id, ts), as ``operators.merge.debounce`` has them in a batch.

    An event is accepted if it comes at least ``window_ms`` after the last accepted one of its key.  Of
    each key only that time is kept, and it goes once the watermark has passed its window; so a
    restart from the checkpoint goes on where the stream was, and state does not grow with old keys.
    Events of a micro-batch are taken in order of time; one that is older than the last accepted
    event of its key is not accepted.
    """
    schema = "key long, event_id long, ms long, accepted boolean"

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches)
        rows["ms"] = rows["ts"].astype("datetime64[us]").astype("int64") // 1000
        rows = rows.sort_values(["ms", "event_id"], kind="stable")
        accepted = []
        for ms in rows["ms"].tolist():
            ok = last is None or ms - last >= window_ms
            last = ms if ok else last
            accepted.append(ok)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": group[0], "event_id": rows["event_id"], "ms": rows["ms"], "accepted": accepted})

    own = events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return own.groupBy("key").applyInPandasWithState(fold, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
