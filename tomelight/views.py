"""The driver's tables as the relations that the operators work on.

These are proxies that keep shapes, keys and value ranges; ``plans/sqlviews.py`` states the same
derivations in SQL.  All times are ISO strings in UTC with milliseconds, as the logs have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .sources.readers import WIKI_DIRS

#: Fixed values, in the order in which files and pages are listed.
PAGE_TYPES = ("source-summary", "concept", "topic", "entity", "contradiction", "open-question")
COMPILATION_TYPES = ("summary", "concept", "topic", "entity", "contradiction", "open-question")
TASK_STATUSES = ("created", "collecting", "synthesizing", "critiquing", "rendering", "completed", "archived", "failed_collecting", "failed_synthesizing", "failed_critiquing", "failed_rendering")
#: Compilations that are made from several sources.
CROSS_TYPES = ("topic", "contradiction", "open-question")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes(m: Column) -> Column:
    """ISO time ``m`` minutes after the start of 2024; independent of the session's time zone."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(m / 1440).cast("int"))
    rest = F.pmod(m, F.lit(1440))
    pad = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), pad(F.floor(rest / 60)), F.lit(":"), pad(rest % 60), F.lit(":00.000Z"))


def iso(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def key(prefix: str, column: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        key("s", k).alias("id"),
        F.concat(F.lit("raw/notes/n"), (k % 700).cast("string"), F.lit(".md")).alias("path"),
        F.col("source").alias("mount_id"),
        F.when(k % 10 == 0, "html").when(k % 10 == 1, "text").otherwise("markdown").alias("type"),
        key("Note ", k).alias("title"),
        minutes(k).alias("ingested_at"),
        T.word_count("text").alias("word_count"),
        T.content_hash("text").alias("hash"),
        k.alias("ord"),
    )


def compilations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    kind = pick(COMPILATION_TYPES, k % 6)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        key("c", k).alias("id"),
        F.when(~kind.isin(*CROSS_TYPES), key("s", k)).alias("source_id"),
        kind.alias("type"),
        F.concat(F.lit("wiki/"), pick(WIKI_DIRS, k % 6), F.lit("/p"), k.cast("string"), F.lit(".md")).alias("output_path"),
        minutes(F.greatest(k + F.when(k % 3 == 0, -30).when(k % 3 == 1, 30).otherwise(60), F.lit(0))).alias("compiled_at"),
        (F.col("toxic") == 1).alias("stale"),
        F.when(F.col("lang") == "en", "claude-sonnet-4-6").when(F.col("lang") == "de", "claude-haiku-4-5").when(F.col("lang") == "fr", "deepseek-v4-flash").otherwise("claude-opus-4-6").alias("model"),
        F.when(k % 7 != 0, F.ceil(F.col("n_chars") / 4).cast("bigint")).alias("tokens_used"),
        k.alias("ord"),
    )


def compilation_sources(spark: SparkSession, d: str) -> DataFrame:
    cross = compilations(spark, d).filter("source_id IS NULL")
    return cross.select(F.when(F.col("ord") % 5 == 0, key("gone", "ord")).otherwise(F.col("id")).alias("compilation_id"), F.explode(F.array(*(key("s", F.col("ord") + j) for j in (0, 1, 5)))).alias("source_id"))


def recall_results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        key("r", k).alias("id"),
        F.col("source").alias("concept"),
        F.col("lang").alias("topic"),
        (F.col("quality") == 1).alias("correct"),
        minutes(k).alias("tested_at"),
        ((k % 11) / 10).alias("confidence"),
        F.when(k % 5 != 0, key("card-", k % 20)).alias("source_card"),
        k.alias("ord"),
    )


def traces(spark: SparkSession, d: str) -> DataFrame:
    stamp = iso("ts")
    return table(spark, d, "events").select(
        key("e", "event_id").alias("id"),
        "event_type",
        F.when(F.col("user_id") % 10 != 0, key("u", "user_id")).alias("correlation_id"),
        stamp.alias("timestamp"),
        F.concat(F.lit("audit/traces/"), F.substring(stamp, 1, 10), F.lit(".jsonl")).alias("file_path"),
        F.col("event_id").alias("line_offset"),
    )


def trace_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines by day file with the hash of the line before; some are tampered with or unreadable."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    day = F.substring(iso("ts"), 1, 10)
    base = e.select(
        F.concat(day, F.lit(".jsonl")).alias("file"),
        F.col("event_id").alias("ord"),
        F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","user":'), F.col("user_id").cast("string"), F.lit("}")).alias("line"),
    )
    own = W.partitionBy("file").orderBy("ord")
    numbered = base.withColumn("line_no", F.row_number().over(own)).withColumn("before", F.lag("line").over(own))
    last = numbered.groupBy("file").agg(F.max_by("line", "line_no").alias("last"))
    # One row a day file: the window below has as many rows as there are days.
    head = last.select(F.col("file").alias("_f"), F.lag("last").over(W.partitionBy(F.lit(1)).orderBy("file")).alias("day_before"))
    joined = numbered.join(head, F.col("file") == F.col("_f"))
    prior = F.when(F.col("line_no") > 1, F.col("before")).when(F.substring("file", 10, 1).isin("4", "8"), F.lit(None)).otherwise(F.col("day_before"))
    return joined.select(
        "file",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.when(F.col("ord") % 997 == 0, F.concat("line", F.lit(" "))).when(F.col("ord") % 1999 == 5, F.lit("not json")).otherwise(F.col("line")).alias("raw"),
        F.sha2(prior, 256).alias("prev_hash"),
        ((F.col("ord") % 997 == 0) | (F.col("ord") % 1999 != 5)).alias("parses"),
        "ord",
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key("t", k).alias("id"), F.col("o_orderpriority").alias("brief"), pick(TASK_STATUSES, k % 11).alias("status"), iso("o_orderdate").alias("created_at"), F.col("o_custkey").alias("owner"), k.alias("ord")
    )


def wiki(spark: SparkSession, d: str) -> DataFrame:
    """Pages with links and citations added to their text."""
    k = F.col("doc_id")
    body = F.concat(
        F.col("text"), F.lit("\nSee [[p"), (k * 7 % 1500).cast("string"), F.lit("]] and [[P"), (k * 13 % 1500).cast("string"), F.lit("|other]] [source: Page "), (k * 3 % 1500).cast("string"), F.lit("].")
    )
    return table(spark, d, "documents").select(
        F.concat(F.lit("wiki/"), pick(WIKI_DIRS, k % 6), F.lit("/p"), k.cast("string"), F.lit(".md")).alias("path"),
        pick(WIKI_DIRS, k % 6).alias("dir"),
        key("p", k).alias("slug"),
        pick(PAGE_TYPES, k % 6).alias("type"),
        F.concat(F.lit("Page "), k.cast("string")).alias("title"),
        F.substring(F.regexp_replace("text", "\n", " "), 1, 40).alias("headline"),
        F.col("lang").alias("tags"),
        body.alias("body"),
        "text",
        k.alias("ord"),
    )


def raw_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whole page files: front matter of several styles and a body."""
    w = wiki(spark, d)
    k = F.col("ord")
    tags = F.when(k % 3 == 0, "tags: [alpha, 'beta', gamma]\n").when(k % 3 == 1, F.lit('tags:\n  - alpha\n  - "beta"\n')).otherwise("")
    ids = F.when(k % 4 == 0, F.concat(F.lit("source_ids: [s"), k.cast("string"), F.lit(", s"), (k + 1).cast("string"), F.lit("]\n"))).otherwise("")
    fm = F.concat(F.lit("---\ntitle: "), F.when(k % 2 == 0, F.concat(F.lit('"'), "title", F.lit('"'))).otherwise(F.col("title")), F.lit("\ntype: "), "type", F.lit("\n"), tags, ids, F.lit("url: http://x.example:80/"), "slug", F.lit("\n---\n\n"))
    return w.select("path", "dir", "slug", "ord", "type", F.when(k % 11 == 0, F.col("text")).otherwise(F.concat(fm, F.col("text"))).alias("raw"))


def promotions(spark: SparkSession, d: str) -> DataFrame:
    """One promotion a document; some went to pages of the wiki, the others to pages that are not there."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        key("pr", k).alias("id"),
        F.concat(F.lit("outputs/reports/r"), k.cast("string"), F.lit(".md")).alias("source_path"),
        F.concat(F.lit("wiki/"), pick(WIKI_DIRS, k % 6), F.when(k % 9 == 0, "/p").otherwise("/q"), k.cast("string"), F.lit(".md")).alias("target_path"),
        minutes(k).alias("promoted_at"),
        k.alias("ord"),
    )


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Generated reports and slides with their front-matter fields; some are incomplete."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.concat(F.when(k % 2 == 0, "outputs/reports/r").otherwise("outputs/slides/r"), k.cast("string"), F.lit(".md")).alias("path"),
        F.when(k % 21 == 0, F.lit(None)).when(k % 2 == 0, "report").when(k % 33 == 0, "poster").otherwise("slides").alias("type"),
        F.when(k % 15 == 0, F.lit("  ")).when(k % 27 == 0, F.lit(None)).otherwise(key("Artifact ", k)).alias("title"),
        F.when(k % 24 == 0, F.lit("not a date")).otherwise(minutes(k)).alias("generated_at"),
        F.when(k % 18 != 0, F.array(key("s", k), key("s", k + 1))).alias("generated_from"),
        F.lit("m1").alias("model"),
        F.when(k % 12 != 0, F.col("n_chars").cast("double") / F.when(k % 30 == 0, 7).otherwise(1)).alias("tokens_used"),
        (k % 5 != 0).alias("marp"),
        F.when(k % 6 == 0, F.array(key("p", k))).alias("source_pages"),
        k.alias("ord"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Whole answers with citations of pages, some twice on a line and some of no page."""
    k = F.col("conv_id") * 10 + F.col("turn")
    line = F.regexp_replace("text", "\n", " ")
    return table(spark, d, "conversations").filter("role = 'assistant'").select(
        k.alias("answer_id"),
        F.concat(
            line, F.lit(" [source: Page "), (k % 1300).cast("string"), F.lit("]\r\nSecond  claim [source:\tpage "), (k * 3 % 2600).cast("string"), F.lit("] again [source: PAGE "), (k * 3 % 2600).cast("string"),
            F.lit(" ]\u00a0\n\tNo claim. [source: Page 0] [source: ]\n"), line, F.lit(" [source: page "), (k % 1300).cast("string"), F.lit("]  "),
        ).alias("text"),
    )
