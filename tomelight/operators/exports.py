"""Exports: card decks, page indexes, quizzes and spool candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .learn import by_name

MOST_CONTENT_BYTES = 65_536
# Memory category of each page type; the semantic index has none.
CATEGORIES = {"source-summary": "reference", "concept": "pattern", "topic": "architecture", "entity": "reference", "contradiction": "troubleshooting", "open-question": "reference"}


def _trimmed(x):
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _from(text: Column, mark: str, skip: int) -> Column:
    """``text`` from ``skip`` characters after the start of the first ``mark``, null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, text.substr(at + skip, F.length(text)))


def _escaped(section: Column) -> Column:
    out = F.btrim(section, F.lit(" \t\n\x0b\f\r"))
    for mark, other in (("\t", "    "), ("\r\n", "<br>"), ("\n", "<br>")):
        out = F.replace(out, F.lit(mark), F.lit(other))
    return out


def anki_cards(cards: DataFrame, topic: str | None = None, key: str = "path") -> DataFrame:
    """key, question, answer, tags of cards with both sections in order; fields escaped for TSV.

    Headings are looked for as they stand after a newline, one after the other, each in a projection
    of its own, so that a text is cut once.  A card is exploded from its two fields: a filter on them
    would move below the projections and do their work again.
    """
    if topic is not None:
        cards = cards.filter(F.col("topic") == topic)
    tags = F.concat(F.lit("topic:"), T.slug_tag("topic"), F.lit(" source:"), T.slug_tag("source"))
    question, answer, t = "\n## Question", "\n## Answer", F.col("_t")
    cut = cards.select(key, tags.alias("tags"), F.concat(F.lit("\n"), "body").alias("_t"))
    cut = cut.select(key, "tags", _from(t, question, len(question)).alias("_t"))
    cut = cut.select(key, "tags", _from(t, "\n", 0).alias("_t"))
    cut = cut.select(key, "tags", F.when(F.instr(t, answer) > 0, t.substr(F.lit(1), F.instr(t, answer) - 1)).alias("_q"), _from(t, answer, len(answer)).alias("_t"))
    cut = cut.select(key, "tags", _escaped(F.col("_q")).alias("question"), _escaped(_from(t, "\n", 1)).alias("answer"))
    whole = F.when((F.col("question") != "") & (F.col("answer") != ""), F.array(F.struct("question", "answer", "tags")))
    return cut.select(key, F.explode(whole).alias("card")).select(key, "card.question", "card.answer", "card.tags")


def page_index(pages: DataFrame) -> DataFrame:
    """dir, title, path, n in the order of the index: one row an entry, with its directory's number of entries.

    The order is a global sort, so a directory of any size is dealt over the partitions.
    """
    sizes = pages.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("dir", "title", "path", "ord").join(sizes, "dir").orderBy("dir", *by_name("title"), "ord").select("dir", "title", "path", "n")


def parse_quiz(quizzes: DataFrame, key: str) -> DataFrame:
    """key, n, question, answer, concept of each question block; the concept is the first source's stem, else the topic."""
    blocks = quizzes.select(key, "topic", F.posexplode(F.slice(F.split("quiz", "## Question "), F.lit(2), F.size(F.split("quiz", "## Question ")))).alias("n", "b"))
    stem = F.regexp_extract("b", r"_sources: (?:[^_,]*/)?([^_,/]+)\.md", 1)
    return blocks.select(
        key,
        (F.col("n") + 1).alias("n"),
        _trimmed(F.regexp_extract("b", r"^[^\n]*\n([\s\S]*?)<details>", 1)).alias("question"),
        F.regexp_extract("b", r"<details>([\s\S]*?)</details>", 1).alias("answer"),
        F.when(F.col("b").rlike("_sources: [^_,]+"), stem).otherwise(F.col("topic")).alias("concept"),
    )


def spool_candidates(pages: DataFrame, workspace: str) -> DataFrame:
    """path, reject, id, title, category, content, tags for each page (path, type, title, body and perhaps tags, an array).

    The first broken rule rejects.
    """
    tags = F.col("tags") if "tags" in pages.columns else F.array().cast("array<string>")
    # A projection of its own: the text is trimmed and hashed once, however often rules name it.
    pages = pages.select("path", "type", "title", F.btrim("body", F.lit(" \t\n\x0b\f\r")).alias("body"), tags.alias("tags"))
    pages = pages.select("path", "type", "title", "body", "tags", F.sha2("body", 256).alias("sha"))
    body = F.col("body")
    category = F.create_map(*(F.lit(x) for p in CATEGORIES.items() for x in p))
    known = F.element_at(category, F.coalesce("type", F.lit("")))
    reject = (
        F.when(F.col("type").isNull() | (known.isNull() & (F.col("type") != "semantic-index")), "MISSING_TYPE")
        .when(F.col("type") == "semantic-index", "SEMANTIC_INDEX_SKIPPED")
        .when(body == "", "EMPTY_CONTENT")
        .when(F.octet_length(body) > MOST_CONTENT_BYTES, "CONTENT_TOO_LARGE")
    )
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.md$", "")
    title = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", stem).otherwise(F.trim("title"))
    name = F.concat(F.lit(workspace), F.lit("\0"), F.col("path"), F.lit("\0"), F.col("sha"))
    return pages.select(
        "path",
        reject.alias("reject"),
        F.when(reject.isNull(), T.uuid5(name)).alias("id"),
        F.when(reject.isNull(), F.when(F.col("type") == "open-question", F.concat(F.lit("Open question: "), title)).otherwise(title)).alias("title"),
        F.when(reject.isNull(), known).alias("category"),
        F.when(reject.isNull(), body).alias("content"),
        F.when(reject.isNull(), F.filter("tags", lambda t: t.rlike("^[a-z0-9][a-z0-9-]*$"))).alias("tags"),
    )


def spool_lines(candidates: DataFrame, tenant: str, captured_at: str, author: tuple[str, str] = ("ai", "compiler"), project: str = "corpus", bulk: bool = False) -> DataFrame:
    """category, path, id, line of the accepted candidates: one JSON object each, keys in the order of the format.

    A bulk emission has another source and no trust.  The flags are the receiver's to set.
    """
    flags = F.struct(*(F.lit(False).alias(n) for n in ("potentialSecret", "lowConfidence", "duplicateSuspect")))
    line = F.struct(
        F.lit("1").alias("schemaVersion"),
        F.col("id"),
        F.lit("inbox").alias("status"),
        F.lit("bulk_import" if bulk else "import").alias("source"),
        F.col("content"),
        F.col("title"),
        F.col("category"),
        F.lit("untrusted" if bulk else "medium").alias("trustLevel"),
        F.struct(F.lit(author[0]).alias("type"), F.lit(author[1]).alias("id")).alias("author"),
        F.lit(tenant).alias("tenantId"),
        F.struct(F.array("path").alias("filePaths"), F.lit(project).alias("projectContext"), F.col("tags")).alias("metadata"),
        flags.alias("prePolicyFlags"),
        F.lit(captured_at).alias("capturedAt"),
    )
    return candidates.filter("reject IS NULL").select("category", "path", "id", F.to_json(line).alias("line"))


def write_spool(lines: DataFrame, path: str, most_lines: int = 50_000) -> DataFrame:
    """Write ``lines`` below ``path`` in files of at most ``most_lines``, then a manifest row a file, which is returned.

    Spark's commit protocol makes the files visible at once and the manifest after them, in a folder
    that readers of the spool pass over.
    """
    lines.select(F.col("line").alias("value")).write.mode("errorifexists").option("maxRecordsPerFile", most_lines).text(path)
    spark = lines.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    count = F.length("content") - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")).cast("binary"))
    manifest = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("spoolFile"), count.cast("long").alias("emittedCount"), F.col("length").alias("spoolFileBytes"), F.sha2("content", 256).alias("spoolFileSha256"))
    manifest.write.json(f"{path}/_manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/_manifest")
