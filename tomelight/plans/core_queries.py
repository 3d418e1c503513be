"""Sources, compilations and their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as T
from ..operators import ingest as I
from ..operators import lineage as L
from .registry import query

_LATEST = "latest AS (SELECT path, arg_max(id, (ingested_at, ord)) AS id, arg_max(hash, (ingested_at, ord)) AS hash, max(ingested_at) AS ingested_at FROM sources GROUP BY path)"


@query("SELECT doc_id, CASE WHEN regexp_matches(p, '\\.(md|mdx)$') THEN 'markdown' WHEN regexp_matches(p, '\\.pdf$') THEN 'pdf' WHEN regexp_matches(p, '\\.html?$') THEN 'html' ELSE 'text' END AS type FROM (SELECT doc_id, lower('Dir.x/' || source || ['.MD', '.mdx', '.pdf', '.HTML', '.htm', '.txt', ''][doc_id % 7 + 1]) AS p FROM documents)")
def detect_source_type(spark: SparkSession, d: str) -> DataFrame:
    ext = V.pick((".MD", ".mdx", ".pdf", ".HTML", ".htm", ".txt", ""), F.col("doc_id") % 7)
    return V.table(spark, d, "documents").select("doc_id", T.source_type(F.concat(F.lit("Dir.x/"), "source", ext)).alias("type"))


@query("SELECT id, path, ingested_at FROM sources WHERE mount_id = 'src3'", "sources")
def list_sources(spark: SparkSession, d: str) -> DataFrame:
    return I.filtered(V.sources(spark, d), [F.desc("ingested_at"), F.col("id")], mount_id="src3").select("id", "path", "ingested_at")


@query("SELECT DISTINCT 'm' || source AS id, source AS name FROM documents")
def list_mounts(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select(V.key("m", "source").alias("id"), F.col("source").alias("name")).distinct().orderBy("name")


@query("SELECT id, brief, status, created_at FROM tasks WHERE status = 'failed_rendering'", "tasks")
def list_tasks(spark: SparkSession, d: str) -> DataFrame:
    return I.filtered(V.tasks(spark, d), [F.col("created_at"), F.col("ord")], status="failed_rendering").select("id", "brief", "status", "created_at")


@query("SELECT id, event_type, correlation_id, timestamp FROM traces WHERE event_type = 'click' AND correlation_id = 'u11' ORDER BY timestamp, line_offset LIMIT 10", "traces")
def read_traces(spark: SparkSession, d: str) -> DataFrame:
    return I.filtered(V.traces(spark, d), [F.col("timestamp"), F.col("line_offset")], 10, event_type="click", correlation_id="u11").select("id", "event_type", "correlation_id", "timestamp")


@query("SELECT id, concept, topic, correct, tested_at FROM recall_results WHERE concept = 'src0' AND topic = 'en' ORDER BY tested_at DESC, ord LIMIT 15", "recall_results")
def list_recall(spark: SparkSession, d: str) -> DataFrame:
    return I.filtered(V.recall_results(spark, d), [F.desc("tested_at"), F.col("ord")], 15, concept="src0", topic="en").select("id", "concept", "topic", "correct", "tested_at")


_PROV = "prov AS (SELECT 's' || (doc_id % 50) AS source_id, 'wiki/topics/t' || (doc_id % 30) || '.md' AS output_path, CASE WHEN doc_id % 2 = 0 THEN 'compile' ELSE 'promote' END AS operation, doc_id AS recorded_at FROM documents)"


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return V.table(spark, d, "documents").select(
        V.key("s", k % 50).alias("source_id"), F.concat(F.lit("wiki/topics/t"), (k % 30).cast("string"), F.lit(".md")).alias("output_path"), F.when(k % 2 == 0, "compile").otherwise("promote").alias("operation"), k.alias("recorded_at")
    )


@query(f"WITH {_PROV} SELECT * FROM prov WHERE output_path = 'wiki/topics/t7.md'")
def provenance_for_output(spark: SparkSession, d: str) -> DataFrame:
    return I.filtered(_provenance(spark, d), [F.col("recorded_at")], output_path="wiki/topics/t7.md")


@query(f"WITH {_PROV} SELECT * FROM prov WHERE source_id = 's3'")
def derivations_of_source(spark: SparkSession, d: str) -> DataFrame:
    return I.filtered(_provenance(spark, d), [F.col("recorded_at")], source_id="s3")


@query(f"WITH {_LATEST} SELECT path, id, hash, ingested_at FROM latest", "sources")
def latest_per_path(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_per_path(V.sources(spark, d))


_CAND = "cand AS (SELECT path, CASE WHEN ord % 4 = 0 THEN sha256(hash) ELSE hash END AS hash FROM (SELECT DISTINCT ON (path) path, hash, ord FROM sources ORDER BY path, ord) UNION ALL SELECT 'raw/notes/new' || r_regionkey || '.md', 'x' FROM region)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    first = I.first_per(V.sources(spark, d).select("path", "hash", "ord"), ["path"], "ord")
    old = first.select("path", F.when(F.col("ord") % 4 == 0, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    new = V.table(spark, d, "region").select(F.concat(F.lit("raw/notes/new"), F.col("r_regionkey").cast("string"), F.lit(".md")).alias("path"), F.lit("x").alias("hash"))
    return old.unionByName(new)


@query(f"WITH {_LATEST}, {_CAND} SELECT c.path, c.hash, l.hash IS NULL OR l.hash <> c.hash AS changed FROM cand c LEFT JOIN latest l USING (path)", "sources")
def source_changed(spark: SparkSession, d: str) -> DataFrame:
    return I.source_changed(_candidates(spark, d), V.sources(spark, d))


@query(
    f"WITH {_LATEST}, {_CAND} SELECT c.path, c.hash, CASE WHEN length(c.path) % 3 = 0 THEN 'raw/papers' ELSE 'raw/notes' END AS raw_dir, CASE WHEN c.path LIKE '%99.md' THEN 'too-large' WHEN l.hash IS NULL THEN 'ingest' WHEN l.hash = c.hash THEN 'unchanged' ELSE 'reingest' END AS state FROM cand c LEFT JOIN latest l USING (path)",
    "sources",
)
def ingest_upsert(spark: SparkSession, d: str) -> DataFrame:
    files = _candidates(spark, d).select("path", "hash", F.when(F.length("path") % 3 == 0, "pdf").otherwise("markdown").alias("type"), F.when(F.col("path").endswith("99.md"), 1 << 30).otherwise(10).alias("n_bytes"))
    return I.ingest_upsert(files, V.sources(spark, d))


@query("SELECT path, hash, arg_min(id, (ingested_at, ord)) AS id FROM (SELECT * FROM sources UNION ALL SELECT * REPLACE ('again' || ord AS id, ord + 100000 AS ord) FROM sources) GROUP BY path, hash", "sources")
def register_source(spark: SparkSession, d: str) -> DataFrame:
    s = V.sources(spark, d)
    again = s.withColumn("id", V.key("again", "ord")).withColumn("ord", F.col("ord") + 100000)
    return I.register_source(s.unionByName(again)).select("path", "hash", "id")


@query(
    "SELECT id, arg_max(type, (compiled_at, ord)) AS type, arg_max(tokens_used, (compiled_at, ord)) FILTER (true) AS tokens_used, max(compiled_at) AS compiled_at, false AS stale FROM (SELECT * FROM compilations WHERE tokens_used IS NOT NULL UNION ALL SELECT * REPLACE (tokens_used * 2 AS tokens_used, CASE WHEN ord % 4 = 0 THEN '2025-01-01T00:00:00.000Z' ELSE '2023-01-01T00:00:00.000Z' END AS compiled_at, ord + 100000 AS ord) FROM compilations WHERE tokens_used IS NOT NULL) GROUP BY id",
    "compilations",
)
def compilation_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = V.compilations(spark, d).filter("tokens_used IS NOT NULL")
    late = F.when(F.col("ord") % 4 == 0, "2025-01-01T00:00:00.000Z").otherwise("2023-01-01T00:00:00.000Z")
    again = c.withColumn("tokens_used", F.col("tokens_used") * 2).withColumn("compiled_at", late).withColumn("ord", F.col("ord") + 100000)
    return I.upsert(c.unionByName(again), "id", "compiled_at").select("id", "type", "tokens_used", "compiled_at", "stale")


@query("SELECT DISTINCT compilation_id, source_id FROM (SELECT * FROM compilation_sources UNION ALL SELECT * FROM compilation_sources)", "compilation_sources")
def link_sources_dedup(spark: SparkSession, d: str) -> DataFrame:
    j = V.compilation_sources(spark, d)
    return j.unionByName(j).dropDuplicates(["compilation_id", "source_id"])


@query("SELECT id, trim(concept_) AS concept, CASE WHEN trim(concept_) = '' THEN 'EMPTY_CONCEPT' WHEN c < 0 OR c > 1 THEN 'BAD_CONFIDENCE' END AS reject FROM (SELECT id, CASE WHEN ord % 7 = 0 THEN '  ' ELSE ' ' || concept || ' ' END AS concept_, confidence + CASE WHEN ord % 5 = 0 THEN 0.5 ELSE 0.0 END AS c FROM recall_results)", "recall_results")
def recall_validate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("ord")
    r = V.recall_results(spark, d).select("id", F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "concept", F.lit(" "))).alias("concept"), (F.col("confidence") + F.when(k % 5 == 0, 0.5).otherwise(0.0)).alias("confidence"))
    return I.validate_recall(r).select("id", "concept", "reject")


_STALE = """SELECT id, output_path, CASE WHEN min(p) = 1 THEN 'source-changed' ELSE 'dependency-recompiled' END AS reason FROM (
  SELECT c.id, output_path, 1 AS p FROM compilations c JOIN sources s ON s.id = c.source_id WHERE s.ingested_at > c.compiled_at
  UNION ALL SELECT id, output_path, 2 FROM compilations WHERE stale) GROUP BY id, output_path"""


@query(_STALE, "compilations", "sources")
def stale_pages(spark: SparkSession, d: str) -> DataFrame:
    return L.stale_pages(V.compilations(spark, d), V.sources(spark, d))


@query("SELECT id, stale OR ord % 6 = 1 AS stale, NOT stale AND ord % 6 = 1 AS changed FROM compilations", "compilations")
def mark_stale(spark: SparkSession, d: str) -> DataFrame:
    c = V.compilations(spark, d)
    return L.mark_stale(c, c.select(F.when(F.col("ord") % 6 == 1, F.col("id")).otherwise(V.key("other", "ord")).alias("id")))


@query("SELECT s.id, s.path FROM sources s LEFT JOIN compilations c ON c.source_id = s.id AND c.type = 'summary' WHERE c.id IS NULL", "sources", "compilations")
def uncompiled_sources(spark: SparkSession, d: str) -> DataFrame:
    return L.uncompiled_sources(V.sources(spark, d), V.compilations(spark, d))


@query(
    "SELECT c.id AS compilation_id, s.id AS source_id, s.path FROM compilations c JOIN sources s ON s.id = c.source_id UNION ALL SELECT j.compilation_id, s.id, s.path FROM compilation_sources j JOIN compilations c ON c.id = j.compilation_id AND c.source_id IS NULL JOIN sources s ON s.id = j.source_id",
    "compilations", "compilation_sources", "sources",
)
def compilation_sources(spark: SparkSession, d: str) -> DataFrame:
    return L.compiled_sources(V.compilations(spark, d), V.compilation_sources(spark, d), V.sources(spark, d))


_CHANGES = "changes AS (SELECT path, CASE WHEN ord % 2 = 0 THEN 'changed' ELSE hash END AS new FROM (SELECT path, arg_max(hash, (ingested_at, ord)) AS hash, arg_max(ord, (ingested_at, ord)) AS ord FROM sources GROUP BY path))"


@query(
    f"""WITH {_LATEST}, {_CHANGES},
seen AS (SELECT l.id AS source_id, l.hash AS old, new FROM changes LEFT JOIN latest l USING (path)),
changed AS (SELECT DISTINCT source_id FROM seen WHERE source_id IS NOT NULL AND old <> new),
flag AS (SELECT max(r) AS r FROM (SELECT 2 AS r FROM seen WHERE source_id IS NULL UNION ALL SELECT 1 FROM changed WHERE source_id NOT IN (SELECT source_id FROM compilation_sources))),
every AS (
  SELECT id, type, output_path, 3 AS r, 1 AS o, 'source-changed' AS reason FROM compilations WHERE source_id IN (SELECT source_id FROM changed)
  UNION ALL SELECT id, type, output_path, 3, 0, 'cited-source-changed' FROM compilations WHERE id IN (SELECT compilation_id FROM compilation_sources JOIN changed USING (source_id))
  UNION ALL SELECT id, type, output_path, r, 0, CASE WHEN r = 2 THEN 'new-source-sweep' ELSE 'uncited-source-sweep' END FROM compilations, flag WHERE source_id IS NULL AND type IN ('topic', 'contradiction', 'open-question') AND r IS NOT NULL)
SELECT id, type, output_path, arg_max(reason, (r, o)) AS reason FROM every GROUP BY id, type, output_path""",
    "sources", "compilations", "compilation_sources",
)
def affected_set(spark: SparkSession, d: str) -> DataFrame:
    s = V.sources(spark, d)
    last = s.groupBy("path").agg(F.max_by(F.struct("hash", "ord"), F.struct("ingested_at", "ord")).alias("r")).select("path", "r.hash", "r.ord")
    changes = last.select("path", F.when(F.col("ord") % 2 == 0, "changed").otherwise(F.col("hash")).alias("hash"))
    return L.affected_set(changes, s, V.compilations(spark, d), V.compilation_sources(spark, d))


_LINKS = "edges AS (SELECT path, slug, dir, ord, unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) AS link FROM wiki)"


@query(f"WITH {_LINKS} SELECT path, slug FROM wiki WHERE dir <> 'sources' AND slug <> 'index' AND slug NOT IN (SELECT trim(split_part(link, '|', 1)) FROM edges)", "wiki")
def orphan_pages(spark: SparkSession, d: str) -> DataFrame:
    return L.orphan_pages(V.wiki(spark, d))


_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query(
    f"WITH {_LINKS}, refs AS (SELECT DISTINCT slug AS referrer, ord, {_SLUG.format('link')} AS slug FROM edges) SELECT slug, referrer, ord, count(*) OVER (PARTITION BY slug) AS n FROM refs WHERE slug IN (SELECT slug FROM wiki)",
    "wiki",
)
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return L.backlinks(V.wiki(spark, d))


# White space of every kind, in the syntax of the other engine's patterns.
_WS = "[\\s\\x0b\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_STRIP = "regexp_replace({0}, '^" + _WS.replace("{", "{{").replace("}", "}}") + "+|" + _WS.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"
_CITES = f"""cut AS (SELECT answer_id, string_split(text, chr(10)) AS ls FROM answers),
lines AS (SELECT answer_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM cut),
marks AS (SELECT answer_id, line_no, line, regexp_extract_all(line, '\\[source:{_WS}*([^\\]]+)\\]', 1) AS ts FROM lines),
found AS (SELECT answer_id, line_no, line, generate_subscripts(ts, 1) AS pos, unnest(ts) AS t FROM marks),
named AS (SELECT answer_id, line_no, pos, {_STRIP.format("t")} AS title, {_STRIP.format("line")} AS bare, {_STRIP.format("regexp_replace(line, '\\[source:[^\\]]+\\]', '', 'g')")} AS claim FROM found),
cites AS (SELECT *, lower(title) AS k FROM named QUALIFY row_number() OVER (PARTITION BY answer_id, lower(title), bare ORDER BY line_no, pos) = 1),
titles AS (SELECT {_STRIP.format("lower(title)")} AS k, arg_max(path, ord) AS page_path FROM wiki GROUP BY 1),
parsed AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY line_no, pos) AS n, title, claim, coalesce(page_path, '') AS page_path FROM cites LEFT JOIN titles USING (k))"""


@query(f"WITH {_CITES} SELECT * FROM parsed", "answers", "wiki")
def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_citations(V.answers(spark, d), V.wiki(spark, d))


@query(f"WITH {_CITES} SELECT answer_id, n, title, page_path, page_path IN (SELECT CASE WHEN ord % 8 = 0 THEN path || '.bak' ELSE path END FROM wiki) AS verified FROM parsed", "answers", "wiki")
def verify_citations(spark: SparkSession, d: str) -> DataFrame:
    w = V.wiki(spark, d)
    return L.verify_citations(L.parse_citations(V.answers(spark, d), w), w.withColumn("path", F.when(F.col("ord") % 8 == 0, F.concat("path", F.lit(".bak"))).otherwise(F.col("path"))))


@query(
    f"""WITH {_CITES},
files AS (SELECT path AS page_path, CASE WHEN ord % 3 = 0 THEN NULL ELSE 'raw/notes/n' || ord || '.md' END AS source_path FROM wiki WHERE ord % 8 <> 0),
once AS (SELECT answer_id, page_path, min(n) AS n, arg_min(title, n) AS title FROM parsed GROUP BY 1, 2),
chain AS (
  SELECT answer_id, 0 AS n, 0 AS k, 'answer' AS level, '(generated answer)' AS path, 'Generated Answer' AS title FROM answers
  UNION ALL SELECT answer_id, n, 0, 'compiled-page', page_path, title FROM once JOIN files USING (page_path)
  UNION ALL SELECT answer_id, n, 1, 'raw-source', source_path, source_path FROM once JOIN files USING (page_path) WHERE source_path IS NOT NULL)
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY n, k) - 1 AS step, level, path, title FROM chain""",
    "answers", "wiki",
)
def provenance_chain(spark: SparkSession, d: str) -> DataFrame:
    """Citations of pages, one in eight of which is gone, back to the sources that two in three of them name."""
    w, k = V.wiki(spark, d), F.col("ord")
    source = F.when(k % 3 != 0, F.concat(F.lit("source_path:  raw/notes/n"), k.cast("string"), F.lit(".md \r\n"))).otherwise("")
    files = w.filter(k % 8 != 0).select("path", F.concat(F.lit("---\ntitle: "), "title", F.lit("\n"), source, F.lit("tags:\n---\n"), "text").alias("raw"))
    a = V.answers(spark, d)
    return L.provenance_chain(a, L.parse_citations(a, w), files)


@query("SELECT path FROM wiki WHERE path NOT IN (SELECT output_path FROM compilations UNION SELECT target_path FROM promotions)", "wiki", "compilations", "promotions")
def unreceipted_pages(spark: SparkSession, d: str) -> DataFrame:
    return L.unreceipted_pages(V.wiki(spark, d), V.compilations(spark, d), V.promotions(spark, d))


_TMP = """files AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'outputs/reports/deep/' WHEN 1 THEN 'wiki/topics/' ELSE 'raw/notes/' END || 'p' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.md' ELSE '.md.tmp' END AS path, 1700000000000 - n_chars * 1000 AS modified_ms FROM documents)"""


@query(f"WITH {_TMP} SELECT path, 1700000000000 - modified_ms AS age_ms FROM files WHERE (starts_with(path, 'wiki/') OR starts_with(path, 'outputs/')) AND ends_with(path, '.tmp') AND 1700000000000 - modified_ms >= 3600000")
def stale_temporaries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, "outputs/reports/deep/").when(k % 3 == 1, "wiki/topics/").otherwise("raw/notes/")
    files = V.table(spark, d, "documents").select(F.concat(folder, V.key("p", k), F.when(k % 4 == 0, ".md").otherwise(".md.tmp")).alias("path"), (F.lit(1_700_000_000_000) - F.col("n_chars") * 1000).alias("modified_ms"))
    return L.stale_temporaries(files, 1_700_000_000_000)


@query("SELECT a.path, a.path IN (SELECT source_path FROM promotions) AS promoted FROM artifacts a", "artifacts", "promotions")
def is_promoted(spark: SparkSession, d: str) -> DataFrame:
    p = V.promotions(spark, d).select(F.col("source_path").alias("path"), F.lit(True).alias("_p")).distinct()
    return V.artifacts(spark, d).select("path").join(p, "path", "left").select("path", F.coalesce("_p", F.lit(False)).alias("promoted"))


_IDS = "adv AS (SELECT 'c' || doc_id AS id, ['s' || doc_id, 's' || (doc_id + 3), 's' || doc_id, 'zz' || (doc_id % 3), 's' || (doc_id * 2)] AS ids FROM documents)"


@query(
    f"""WITH {_IDS}, one AS (SELECT id, x, min(p) AS p FROM (SELECT id, unnest(ids) AS x, generate_subscripts(ids, 1) AS p FROM adv) GROUP BY id, x),
j AS (SELECT id, x, p, x IN (SELECT source_id FROM compilations WHERE type = 'summary') AS k FROM one)
SELECT id, coalesce(list(x ORDER BY p) FILTER (k), []) AS kept, count(*) FILTER (NOT k) AS dropped, CASE WHEN bool_or(k) THEN 'advisory' ELSE 'fallback' END AS mode FROM j GROUP BY id""",
    "compilations", lists=("kept",)
)
def source_attribution(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = V.table(spark, d, "documents").select(V.key("c", k).alias("id"), F.array(V.key("s", k), V.key("s", k + 3), V.key("s", k), V.key("zz", k % 3), V.key("s", k * 2)).alias("ids"))
    return L.attribute_sources(rows, V.compilations(spark, d).filter("type = 'summary'").select("source_id"))


@query("SELECT id, CAST(floor((row_number() OVER (PARTITION BY mount_id ORDER BY ord) - 1) / 25) AS BIGINT) AS batch FROM sources", "sources")
def batching(spark: SparkSession, d: str) -> DataFrame:
    return I.batches(V.sources(spark, d), "ord", 25, "mount_id").select("id", "batch")
