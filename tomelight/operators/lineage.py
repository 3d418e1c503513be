"""What a change makes stale, and who links to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..views import CROSS_TYPES
from .ingest import latest_per_path


def stale_pages(compilations: DataFrame, sources: DataFrame) -> DataFrame:
    """id, output_path, reason: sources newer than the page, else pages flagged stale."""
    s = sources.select(F.col("id").alias("source_id"), "ingested_at")
    newer = compilations.join(s, "source_id").filter("ingested_at > compiled_at").select("id", "output_path", F.lit(1).alias("p"))
    flagged = compilations.filter("stale").select("id", "output_path", F.lit(2).alias("p"))
    best = newer.unionByName(flagged).groupBy("id", "output_path").agg(F.min("p").alias("p"))
    return best.select("id", "output_path", F.when(F.col("p") == 1, "source-changed").otherwise("dependency-recompiled").alias("reason"))


def mark_stale(compilations: DataFrame, ids: DataFrame) -> DataFrame:
    """Compilations with ``stale`` set for ``ids.id``, and whether that changed them."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = compilations.join(hit, "id", "left")
    return j.select("id", (F.col("stale") | F.col("_hit").isNotNull()).alias("stale"), (~F.col("stale") & F.col("_hit").isNotNull()).alias("changed"))


def uncompiled_sources(sources: DataFrame, compilations: DataFrame) -> DataFrame:
    done = compilations.filter("type = 'summary'").select(F.col("source_id").alias("id"))
    return sources.join(done, "id", "left_anti").select("id", "path")


def compiled_sources(compilations: DataFrame, junction: DataFrame, sources: DataFrame) -> DataFrame:
    """compilation_id, source_id, path: the page's own source, else those of the junction."""
    s = sources.select(F.col("id").alias("source_id"), "path")
    own = compilations.filter("source_id IS NOT NULL").select(F.col("id").alias("compilation_id"), "source_id")
    many = compilations.filter("source_id IS NULL").select(F.col("id").alias("compilation_id")).join(junction, "compilation_id")
    return own.unionByName(many).join(s, "source_id").select("compilation_id", "source_id", "path")


def affected_set(changes: DataFrame, sources: DataFrame, compilations: DataFrame, junction: DataFrame) -> DataFrame:
    """id, type, output_path, reason of every page that ``changes`` (path, hash) touch.

    Own pages of a changed source, then pages that cite it.  If a changed source is new or nothing
    cites it, all pages over several sources are swept in.
    """
    latest = latest_per_path(sources).select("path", F.col("id").alias("source_id"), F.col("hash").alias("old"))
    seen = changes.select("path", F.col("hash").alias("new")).join(latest, "path", "left")
    changed = seen.filter("source_id IS NOT NULL AND old <> new").select("source_id").distinct()
    own = compilations.join(changed, "source_id").select("id", "type", "output_path", F.lit(3).alias("rank"), F.lit("source-changed").alias("reason"))
    cites = junction.join(changed, "source_id")
    citing = cites.select(F.col("compilation_id").alias("id")).distinct().join(compilations, "id").select("id", "type", "output_path", F.lit(3).alias("rank"), F.lit("cited-source-changed").alias("reason"))
    uncited = changed.join(junction, "source_id", "left_anti")
    new = seen.filter("source_id IS NULL")
    flag = new.select(F.lit(2).alias("rank")).unionByName(uncited.select(F.lit(1).alias("rank"))).agg(F.max("rank").alias("rank"))
    cross = compilations.filter(F.col("source_id").isNull() & F.col("type").isin(*CROSS_TYPES))
    # The flag is a single row.
    swept = cross.crossJoin(F.broadcast(flag)).filter("rank IS NOT NULL").select("id", "type", "output_path", "rank", F.when(F.col("rank") == 2, "new-source-sweep").otherwise("uncited-source-sweep").alias("reason"))
    every = own.unionByName(citing).unionByName(swept)
    best = every.groupBy("id", "type", "output_path").agg(F.max_by("reason", F.struct("rank", F.col("reason") == "source-changed")).alias("reason"))
    return best


def link_edges(pages: DataFrame) -> DataFrame:
    """path, slug, dir, target (alias cut, as written) of every wikilink."""
    return pages.select("path", "slug", "dir", F.explode(T.wikilinks("body")).alias("link")).select("path", "slug", "dir", F.trim(F.substring_index("link", "|", 1)).alias("target"), "link")


def orphan_pages(pages: DataFrame) -> DataFrame:
    """Pages outside sources that no page links to; targets are taken as written."""
    targets = link_edges(pages).select(F.col("target").alias("slug")).distinct()
    return pages.filter("dir <> 'sources' AND slug <> 'index'").join(targets, "slug", "left_anti").select("path", "slug")


def backlinks(pages: DataFrame) -> DataFrame:
    """slug, referrer, ord, n: who links to each page by slugified link text, one row a link, and how many do.

    ``ord`` is the referrer's place.  Pages of one slug share the references of the last of them.
    """
    last = pages.groupBy("slug").agg(F.max_by(F.struct("body", "ord"), "ord").alias("r")).select("slug", "r.body", "r.ord")
    refs = last.select(F.col("slug").alias("referrer"), "ord", F.explode(T.wikilinks("body")).alias("link"))
    edges = refs.select("referrer", "ord", T.slug_link("link").alias("slug")).distinct()
    known = edges.join(pages.select("slug").distinct(), "slug")
    return known.join(known.groupBy("slug").agg(F.count(F.lit(1)).alias("n")), "slug").select("slug", "referrer", "ord", "n")


def unreceipted_pages(pages: DataFrame, compilations: DataFrame, promotions: DataFrame) -> DataFrame:
    """Pages that neither a compilation nor a promotion accounts for."""
    known = compilations.select(F.col("output_path").alias("path")).unionByName(promotions.select(F.col("target_path").alias("path"))).distinct()
    return pages.join(known, "path", "left_anti").select("path")


#: Where pages are written, and how long a write may take.
SWEPT_FOLDERS = ("wiki/sources", "wiki/concepts", "wiki/entities", "wiki/topics", "wiki/contradictions", "wiki/open-questions", "outputs/reports", "outputs/slides")
TEMPORARY_MS = 60 * 60 * 1000


def stale_temporaries(files: DataFrame, now_ms: int, most_ms: int = TEMPORARY_MS) -> DataFrame:
    """path, age_ms of the temporary files (path, modified_ms) below the folders of pages that no writer can still be at."""
    age = F.lit(now_ms) - F.col("modified_ms")
    below = F.col("path").rlike("^(" + "|".join(SWEPT_FOLDERS) + ")/") & F.col("path").endswith(".tmp")
    return files.filter(below & (age >= most_ms)).select("path", age.alias("age_ms"))


def parse_citations(answers: DataFrame, titles: DataFrame) -> DataFrame:
    """answer_id, n, title, claim, page_path: citations in order, once for each title and line; unknown pages get ''.

    Titles are the same in any case; the first spelling of an answer's line stays.  The claim is the
    line without its citations.  Of pages with one title the last counts.
    """
    lines = answers.select("answer_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = lines.select("answer_id", "line_no", "line", F.posexplode(T.source_citations("line")).alias("at", "title"))
    place = F.struct("line_no", "at")
    once = found.groupBy("answer_id", F.lower("title").alias("key"), T.trimmed("line").alias("line")).agg(F.min_by("title", place).alias("title"), F.min(place).alias("place"))
    index = titles.groupBy(T.trimmed(F.lower("title")).alias("key")).agg(F.max_by("path", "ord").alias("page_path"))
    claim = T.trimmed(F.regexp_replace("line", r"\[source:[^\]]+\]", ""))
    cited = once.join(index, "key", "left").select("answer_id", "place", "title", claim.alias("claim"), F.coalesce("page_path", F.lit("")).alias("page_path"))
    # An answer is one row of text, so its citations are few enough for a window.
    return cited.select("answer_id", F.row_number().over(W.partitionBy("answer_id").orderBy("place")).cast("long").alias("n"), "title", "claim", "page_path")


def verify_citations(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Each citation with whether its page exists."""
    have = pages.select(F.col("path").alias("page_path"), F.lit(True).alias("_have")).distinct()
    return citations.join(have, "page_path", "left").select("answer_id", "n", "title", "page_path", F.coalesce("_have", F.lit(False)).alias("verified"))


def provenance_chain(answers: DataFrame, citations: DataFrame, pages: DataFrame) -> DataFrame:
    """answer_id, step, level, path, title: from each answer over its existing pages to their raw sources.

    ``pages`` (path, raw) are whole files; a page stands once in an answer's chain, under the title it
    was first cited by, and its ``source_path``, if its front matter has one, follows it.
    """
    source = pages.select(F.col("path").alias("page_path"), F.element_at(T.fm_flat("raw", r"^---[^\n]*\n"), "source_path").alias("source_path"))
    first = citations.filter("page_path <> ''").groupBy("answer_id", "page_path").agg(F.min("n").alias("n"), F.min_by("title", "n").alias("title"))
    levels = (F.struct(F.lit(0).alias("k"), F.lit("compiled-page").alias("level"), F.col("page_path").alias("path"), "title"), F.struct(F.lit(1).alias("k"), F.lit("raw-source").alias("level"), F.col("source_path").alias("path"), F.col("source_path").alias("title")))
    below = first.join(source, "page_path").select("answer_id", "n", F.explode(F.filter(F.array(*levels), lambda x: x["path"].isNotNull())).alias("e")).select("answer_id", "n", "e.*")
    top = answers.select("answer_id", F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.lit("answer").alias("level"), F.lit("(generated answer)").alias("path"), F.lit("Generated Answer").alias("title"))
    step = F.row_number().over(W.partitionBy("answer_id").orderBy("n", "k")) - 1
    return top.unionByName(below).select("answer_id", step.cast("long").alias("step"), "level", "path", "title")


def attribute_sources(rows: DataFrame, known: DataFrame) -> DataFrame:
    """id, kept (known advisory ids, first order, once each), dropped, mode."""
    one = rows.select("id", F.posexplode("ids").alias("pos", "source_id")).groupBy("id", "source_id").agg(F.min("pos").alias("pos"))
    judged = one.join(known.select("source_id").distinct().withColumn("_known", F.lit(True)), "source_id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "source_id", F.col("_known").isNotNull().alias("k"))))
    out = judged.groupBy("id").agg(ordered.alias("o"))
    kept = F.transform(F.filter("o", lambda x: x["k"]), lambda x: x["source_id"])
    return out.select("id", kept.alias("kept"), F.size(F.filter("o", lambda x: ~x["k"])).cast("bigint").alias("dropped"), F.when(F.size(kept) > 0, "advisory").otherwise("fallback").alias("mode"))
