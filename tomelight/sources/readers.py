"""Reading files and turning raw rows into records.

Readers take a folder or glob and leave listing, splitting and column pruning to Spark; parsers take
the raw rows, so they work on tables as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The folders of a wiki's pages.
WIKI_DIRS = ("sources", "concepts", "topics", "entities", "contradictions", "open-questions")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, raw of every Markdown file below ``path``."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx}").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))


def read_wiki(spark: SparkSession, root: str) -> DataFrame:
    """path, dir, slug, raw of the pages in the wiki's own folders below ``root``; other folders and files are passed over."""
    pages = read_markdown(spark, f"{root}/wiki").withColumn("dir", F.regexp_extract("path", "/wiki/([^/]+)/[^/]+$", 1))
    return pages.filter(F.col("dir").isin(*WIKI_DIRS)).select("path", "dir", F.regexp_extract("path", r"([^/]+)\.mdx?$", 1).alias("slug"), "raw")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm}").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, raw, parses of every line of a trace folder; hashing needs the raw line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).filter("trim(value) <> ''")
    return lines.select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.col("value").alias("raw"), F.try_parse_json("value").isNotNull().alias("parses"))


def parse_markdown(pages: DataFrame) -> DataFrame:
    """``pages`` (raw) with title, author, date, tags, body and words; the title falls back to the first heading."""
    body = F.when(F.col("raw").startswith("---\n"), T.fm_body("raw")).otherwise(F.col("raw"))
    heading = F.trim(F.regexp_extract("body", r"(?m)^#[ \t]+(.+)$", 1))
    full = pages.withColumn("body", body)
    return full.select(
        "*",
        F.coalesce(T.fm_field("raw", "title"), F.when(heading != "", heading)).alias("title"),
        T.fm_field("raw", "author").alias("author"),
        T.fm_field("raw", "date").alias("date"),
        T.fm_list("raw", "tags").alias("tags"),
        T.word_count("body").alias("words"),
    )


def _first(html: str, pattern: str):
    found = F.regexp_extract(html, pattern, 1)
    return F.when(found != "", F.trim(found))


def parse_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with title, canonical, author, date, plain text, Markdown and its words; attribute order may vary."""
    meta = lambda a, v: F.coalesce(_first(html, rf'(?i)<meta\s+{a}="{v}"\s+content="([^"]*)"'), _first(html, rf'(?i)<meta\s+content="([^"]*)"\s+{a}="{v}"'))
    body = F.coalesce(_first(html, r"(?i)<body[^>]*>([\s\S]*?)</body>"), F.col(html))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?i)<(script|style)[^>]*>[\s\S]*?</(script|style)>", " "), r"<[^>]+>", " "), r"\s+", " ")
    return pages.select(
        "*",
        _first(html, r"(?i)<title[^>]*>([^<]*)</title>").alias("title"),
        F.coalesce(_first(html, r'(?i)<link\s+[^>]*rel="canonical"[^>]*href="([^"]+)"'), _first(html, r'(?i)<link\s+[^>]*href="([^"]+)"[^>]*rel="canonical"'), meta("property", "og:url")).alias("canonical"),
        F.coalesce(meta("name", "author"), meta("property", "article:author")).alias("author"),
        F.coalesce(meta("property", "article:published_time"), _first(html, r'(?i)<time\s+[^>]*datetime="([^"]+)"')).alias("date"),
        F.trim(text).alias("text"),
        T.html_markdown(T.html_body(html)).alias("markdown"),
    ).withColumn("words", T.word_count("markdown"))


def ingest_sources(files: DataFrame) -> DataFrame:
    """path, type, title, author, date, words, body of raw files (path, raw), each read as its extension says.

    Both readers run over their own rows only; plain text is read as Markdown.
    """
    typed = files.withColumn("type", T.source_type("path")).filter("type <> 'pdf'")
    notes = parse_markdown(typed.filter("type <> 'html'")).select("path", "type", "title", "author", "date", "words", "body")
    clips = parse_html(typed.filter("type = 'html'"), "raw").select("path", "type", "title", "author", "date", "words", F.col("markdown").alias("body"))
    return notes.unionByName(clips)


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes, type of the files below ``path`` that can be ingested; file contents are not read."""
    from ..operators.records import supported_files

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("n_bytes"))
    return supported_files(listed).select("path", "n_bytes", T.source_type("path").alias("type"))


def scan_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (raw) with front matter, trimmed body and its hash."""
    body = F.when(F.col("raw").startswith("---"), F.regexp_replace("raw", r"^---[ \t]*\n[\s\S]*?\n---[^\n]*", "")).otherwise(F.col("raw"))
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    return pages.select("*", T.fm_flat("raw").alias("fm"), trimmed.alias("body"), F.sha2(trimmed, 256).alias("body_sha256"))


def parse_audit_log(lines: DataFrame) -> DataFrame:
    """ord, at, operation, summary of the pipe-table rows of a log; header and rule rows go."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.filter(F.trim("line").startswith("|")).select("ord", cells.alias("c")).filter(F.size("c") >= 3)
    return rows.filter((F.get("c", F.lit(0)) != "Timestamp") & ~F.get("c", F.lit(0)).rlike("^:?-+:?$")).select("ord", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("at", "operation", "summary"))))


def list_artifacts(artifacts: DataFrame, promotions: DataFrame) -> DataFrame:
    """Complete artifacts with a promoted flag, newest first, unreadable dates last."""
    whole = artifacts.filter("type IS NOT NULL AND title IS NOT NULL AND trim(title) <> '' AND generated_from IS NOT NULL AND tokens_used IS NOT NULL")
    p = promotions.select(F.col("source_path").alias("path"), F.lit(True).alias("_p")).distinct()
    out = whole.join(p, "path", "left").select("path", "type", "title", "generated_at", F.coalesce("_p", F.lit(False)).alias("promoted"))
    return out.orderBy(F.desc_nulls_last(F.try_to_timestamp("generated_at")), "path")


def specs_of_bank(bank: DataFrame) -> DataFrame:
    """id, question, threshold, verification_mode: one spec per intent and paraphrase."""
    each = bank.select("id", F.posexplode("paraphrases").alias("p", "question"), "recall_floor", "verification_mode")
    return each.select(F.concat_ws("-", "id", F.col("p").cast("string")).alias("id"), "question", F.col("recall_floor").alias("threshold"), F.when(F.col("verification_mode") == "weak", "weak").otherwise("strong").alias("verification_mode"))


def trace_summary(lines: DataFrame) -> DataFrame:
    """file, n_lines, n_events of readable log lines; the cheap substring test comes before parsing."""
    counted = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("parses").alias("n_readable"))
    marked = lines.filter(F.col("raw").contains('"event_type":"purchase"') & F.col("parses")).filter(F.get_json_object("raw", "$.event_type") == "purchase")
    return counted.join(marked.groupBy("file").agg(F.count(F.lit(1)).alias("_n")), "file", "left").select("file", "n_lines", "n_readable", F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_marked"))
