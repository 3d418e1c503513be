"""Row numbers within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import new_path


def numbered(df: DataFrame, group: str, order: list[str], name: str = "nth") -> DataFrame:
    """``df`` with each row's number, from 1, in its ``group`` by ``order`` (ties in any order).

    Rows are range-partitioned by group and order and numbered in their partition; a row's number in
    its group adds what the group has in earlier partitions, a table of one row a group and
    partition.  The sorted rows are kept in the shared folder, so that both see the same partitions.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    path = new_path(df.sparkSession, "numbered")
    ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    parts = rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_group").orderBy("_p")) - F.col("_n")
    offsets = parts.select("_group", "_p", (before - F.col("_first") + 1).alias("_shift"))
    joined = rows.join(offsets, rows[group].eqNullSafe(offsets["_group"]) & (rows["_part"] == offsets["_p"]))
    return joined.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_group", "_p", "_shift")
