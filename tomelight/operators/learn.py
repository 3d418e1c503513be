"""Retention over recall results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def retention_by_concept(results: DataFrame) -> DataFrame:
    return results.groupBy("concept").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"), F.avg(F.col("correct").cast("int")).alias("retention"), F.max("tested_at").alias("last_tested"))


def by_name(column: str) -> tuple[Column, Column]:
    """The order of names in a list for people: by letter, then accents and case; names that are alike there by their bytes."""
    return F.collate(column, "UNICODE").asc(), F.col(column).asc()


def weak_areas(results: DataFrame, least: int = 1, most: float = 1.0, limit: int = 10) -> DataFrame:
    r = retention_by_concept(results).filter((F.col("total") >= least) & (F.col("retention") <= most))
    return r.orderBy("retention", F.desc("total"), *by_name("concept")).limit(limit)


def retention_report(results: DataFrame, least: int = 1, top: int = 5) -> DataFrame:
    """section, concept, total, retention: totals over all concepts, then the weakest and strongest."""
    r = retention_by_concept(results)
    columns = lambda df, s: df.select(F.lit(s).alias("section"), "concept", "total", "retention")
    whole = r.agg(F.lit(None).cast("string").alias("concept"), F.sum("total").alias("total"), (F.sum("correct") / F.sum("total")).alias("retention"))
    enough = r.filter(F.col("total") >= least)
    weak = enough.orderBy("retention", F.desc("total"), *by_name("concept")).limit(top)
    strong = enough.orderBy(F.desc("retention"), F.desc("total"), *by_name("concept")).limit(top)
    return columns(whole, "all").unionByName(columns(weak, "weakest")).unionByName(columns(strong, "strongest"))


def running_retention(answers: DataFrame) -> DataFrame:
    """Each answer with its concept's retention so far and whether it is the concept's first miss."""
    own = W.partitionBy("concept").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    misses = F.sum((~F.col("correct")).cast("int")).over(own)
    return answers.select("id", "concept", "correct", F.avg(F.col("correct").cast("int")).over(own).alias("retention"), (~F.col("correct") & (misses == 1)).alias("first_miss"))
