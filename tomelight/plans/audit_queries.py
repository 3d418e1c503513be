"""Logs, anchors, reconciliation, learning, cost, status and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import views as V
from ..functions import text as T
from ..operators import audit as A
from ..operators import cost as C
from ..operators import evals as E
from ..operators import learn as N
from ..operators import lineage as L
from ..operators import merge as M
from ..operators import search as S
from ..operators.exports import spool_candidates
from . import search_queries as Q
from .core_queries import _LINKS, _STALE
from ..operators.numbering import numbered
from .registry import query
from .text_queries import _PRICE, SCHEMA_SQL, schema_pages

# --- logs ---------------------------------------------------------------------------------------

_GOOD = "bad AS (SELECT file, min(line_no) AS bad_line FROM trace_lines WHERE NOT parses GROUP BY file), good AS (SELECT t.* FROM trace_lines t LEFT JOIN bad USING (file) WHERE bad_line IS NULL OR line_no < bad_line)"


@query(
    f"""WITH {_GOOD}, chk AS (SELECT *, sha256(lag(raw) OVER (PARTITION BY file ORDER BY line_no)) AS want FROM good),
per AS (SELECT file, count(*) AS events, count(*) FILTER (line_no > 1 AND prev_hash IS DISTINCT FROM want) AS breaks, arg_min_null(prev_hash, line_no) AS fp, arg_max(raw, line_no) AS lr FROM chk GROUP BY file),
st AS (SELECT *, sha256(lag(lr) OVER (ORDER BY file)) AS before, row_number() OVER (ORDER BY file) AS nth FROM per)
SELECT f.file, coalesce(events, 0) AS events, coalesce(breaks, 0) AS breaks, bad_line, coalesce(CASE WHEN nth = 1 THEN CASE WHEN fp IS NULL THEN 'first' ELSE 'broken' END WHEN fp IS NULL THEN 'legacy' WHEN fp = before THEN 'linked' WHEN nth IS NOT NULL THEN 'broken' END, 'empty') AS boundary
FROM (SELECT DISTINCT file FROM trace_lines) f LEFT JOIN st USING (file) LEFT JOIN bad USING (file)""",
    "trace_lines",
)
def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    return A.verify_chain(V.trace_lines(spark, d))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    t = V.trace_lines(spark, d)
    return t.groupBy("file").agg((F.count(F.lit(1)) + F.when(F.substring("file", 9, 2).isin("05", "09"), 3).otherwise(0)).alias("indexed"))


@query(
    """WITH step AS (SELECT *, sha256(lag(raw) OVER (PARTITION BY file ORDER BY line_no)) AS want FROM trace_lines),
p AS (SELECT file, line_no, CASE WHEN NOT parses THEN 'BAD_JSON' WHEN line_no > 1 AND prev_hash IS DISTINCT FROM want THEN 'HASH_MISMATCH' END AS problem FROM step),
f AS (SELECT file, arg_min(problem, line_no) AS problem, min(line_no) AS line_no FROM p WHERE problem IS NOT NULL GROUP BY file)
SELECT * FROM f UNION ALL SELECT DISTINCT file, 'TRUNCATED', NULL::BIGINT FROM trace_lines WHERE substring(file, 9, 2) IN ('05', '09') AND file NOT IN (SELECT file FROM f)""",
    "trace_lines",
)
def audit_chain_smoke(spark: SparkSession, d: str) -> DataFrame:
    return A.chain_smoke(V.trace_lines(spark, d), _indexed(spark, d))


_BODY = """'{"schemaVersion":1,"anchoredAt":"2024-02-01T00:00:00.000Z","workspaceId":"w","totalEvents":' || total || ',"chainHead":"' || head || '","prevAnchorHash":' || CASE WHEN prev IS NULL THEN 'null' ELSE '"' || prev || '"' END || '}'"""


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Three anchors at quarters of the log, the third beyond its end, the second's head altered."""
    lines = V.trace_lines(spark, d)
    placed = A._positions(lines)
    total = lines.agg(F.count(F.lit(1)).alias("n"))
    at = placed.crossJoin(F.broadcast(total)).filter((F.col("position") == F.floor(F.col("n") / 4)) | (F.col("position") == F.floor(F.col("n") / 2)))
    heads = at.agg(F.min_by("raw", "position").alias("r1"), F.max_by("raw", "position").alias("r2"), F.min("position").alias("p1"), F.max("position").alias("p2"), F.first("n").alias("n"))
    one = heads.select("*", F.sha2("r1", 256).alias("h1"), F.sha2(F.concat("r2", F.lit("x")), 256).alias("h2"), F.lit("z").alias("h3"), (F.col("n") + 5).alias("p3"))
    a1 = F.sha2(A.anchor_body(F.col("p1"), F.col("h1"), F.lit(None).cast("string")), 256)
    two = one.withColumn("a1", a1).withColumn("a2", F.sha2(A.anchor_body(F.col("p2"), F.col("h2"), F.col("a1")), 256)).withColumn("a3", F.sha2(A.anchor_body(F.col("p3"), F.col("h3"), F.col("a2")), 256))
    row = lambda n, prev: F.struct(F.lit(n).alias("n"), F.col(f"p{n}").alias("total"), F.col(f"h{n}").alias("head"), prev.alias("prev_hash"), F.col(f"a{n}").alias("anchor_hash"))
    return two.select(F.explode(F.array(row(1, F.lit(None).cast("string")), row(2, F.col("a1")), row(3, F.col("a2")))).alias("r")).select("r.*")


@query(
    f"""WITH pos AS (SELECT raw, row_number() OVER (ORDER BY file, line_no) AS position FROM trace_lines), n AS (SELECT count(*) AS n FROM pos),
heads AS (SELECT 1 AS n, position AS total, sha256(raw) AS head FROM pos WHERE position = (SELECT n // 4 FROM n) UNION ALL SELECT 2, position, sha256(raw || 'x') FROM pos WHERE position = (SELECT n // 2 FROM n) UNION ALL SELECT 3, n + 5, 'z' FROM n),
a1 AS (SELECT *, sha256({_BODY}) AS own FROM (SELECT *, NULL AS prev FROM heads WHERE n = 1)), a2 AS (SELECT *, sha256({_BODY}) AS own FROM (SELECT heads.*, (SELECT own FROM a1) AS prev FROM heads WHERE n = 2)), a3 AS (SELECT *, sha256({_BODY}) AS own FROM (SELECT heads.*, (SELECT own FROM a2) AS prev FROM heads WHERE n = 3)),
anchor AS (SELECT *, lag(own) OVER (ORDER BY n) AS before, sha256({_BODY}) AS again FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3))
SELECT anchor.n, CASE WHEN own <> again THEN 'SELF_HASH' WHEN prev IS DISTINCT FROM before THEN 'LINK' WHEN (SELECT n FROM n) < total THEN 'TRUNCATED' WHEN sha256(raw) <> head THEN 'REWRITTEN' ELSE 'ok' END AS verdict FROM anchor LEFT JOIN pos ON position = total""",
    "trace_lines",
)
def anchor_verify(spark: SparkSession, d: str) -> DataFrame:
    return A.verify_anchors(_anchors(spark, d), V.trace_lines(spark, d))


@query(
    f"""WITH now AS (SELECT count(*) AS total, sha256(arg_max(raw, (file, line_no))) AS head, sha256('prior') AS prev FROM trace_lines)
SELECT 2 AS n, total, head, prev AS prev_hash, sha256({_BODY}) AS anchor_hash FROM now""",
    "trace_lines",
)
def anchor_append(spark: SparkSession, d: str) -> DataFrame:
    last = spark.range(1).select(F.lit(1).alias("n"), F.lit(10).cast("bigint").alias("total"), F.lit("old").alias("head"), F.sha2(F.lit("prior"), 256).alias("anchor_hash"))
    return A.append_anchor(V.trace_lines(spark, d), last)


@query(
    """WITH RECURSIVE e AS (SELECT strftime(ts, '%Y-%m-%d') AS file, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS line_no, props AS payload FROM events),
c AS (SELECT file, line_no, '{"payload":' || payload || ',"prev_hash":null}' AS line FROM e WHERE line_no = 1
  UNION ALL SELECT e.file, e.line_no, '{"payload":' || payload || ',"prev_hash":"' || sha256(c.line) || '"}' FROM c JOIN e ON e.file = c.file AND e.line_no = c.line_no + 1)
SELECT file, line_no, sha256(line) AS line_hash FROM c"""
)
def trace_append(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select(F.substring(V.iso("ts"), 1, 10).alias("file"), "event_id", F.col("props").alias("payload"))
    return A.build_chain(numbered(e, "file", ["event_id"], "line_no")).select("file", "line_no", F.sha2("line", 256).alias("line_hash"))


@query("SELECT file, count(*) AS n_lines, count(*) FILTER (parses) AS n_readable, count(*) FILTER (parses AND json_extract_string(CASE WHEN parses THEN raw END, '$.event_type') = 'purchase') AS n_marked FROM trace_lines GROUP BY file", "trace_lines")
def trace_scan(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.readers import trace_summary

    return trace_summary(V.trace_lines(spark, d))


_SIDES = "SELECT 's' || (doc_id % 50) AS source_id, 'wiki/topics/t' || (doc_id % 30) || '.md' AS output_path, CASE WHEN doc_id % {0} = 0 THEN 'restore' WHEN doc_id % 2 = 0 THEN 'compile' ELSE 'promote' END AS operation FROM documents"
_KEYS = "source_id, output_path, operation"


@query(
    f"""WITH t AS (SELECT {_KEYS}, count(*) AS n_trace FROM ({_SIDES.format(7)}) GROUP BY ALL), s AS (SELECT {_KEYS}, count(*) AS n_sidecar FROM ({_SIDES.format(5)}) GROUP BY ALL),
j AS (SELECT {_KEYS}, coalesce(n_trace, 0) AS n_trace, coalesce(n_sidecar, 0) AS n_sidecar FROM t FULL JOIN s USING ({_KEYS}))
SELECT *, CASE WHEN n_sidecar < n_trace THEN 'PROVENANCE_SIDECAR_MISSING' END AS code, greatest(n_sidecar - n_trace, 0) AS unreceipted FROM j"""
)
def provenance_reconcile(spark: SparkSession, d: str) -> DataFrame:
    from .core_queries import _provenance

    p, k = _provenance(spark, d), F.col("recorded_at")
    other = lambda n: p.withColumn("operation", F.when(k % n == 0, "restore").otherwise(F.col("operation")))
    return A.reconcile_provenance(other(7), other(5))


@query(
    """WITH i AS (SELECT strftime(ts, '%Y-%m-%d') || CASE WHEN day(ts) % 7 = 0 OR day(ts) % 5 = 0 AND event_id % 9 = 0 THEN '.idx' ELSE '' END AS file, count(*) AS indexed FROM events GROUP BY 1),
k AS (SELECT strftime(ts, '%Y-%m-%d') || CASE WHEN day(ts) % 6 = 0 OR day(ts) % 4 = 0 AND event_id % 9 = 0 THEN '.new' ELSE '' END AS file, count(*) AS on_disk FROM events GROUP BY 1)
SELECT file, indexed, on_disk, CASE WHEN on_disk IS NULL THEN 'MISSING_FILE' WHEN indexed IS NULL THEN 'UNINDEXED_FILE' WHEN on_disk < indexed THEN 'TRUNCATED' WHEN on_disk > indexed THEN 'UNINDEXED_EVENTS' ELSE 'ok' END AS status FROM i FULL JOIN k USING (file)"""
)
def trace_index_reconcile(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("event_id", F.substring(V.iso("ts"), 1, 10).alias("file")).withColumn("day", F.substring("file", 9, 2).cast("int"))
    n9, day = F.col("event_id") % 9 == 0, F.col("day")
    named = lambda odd, end: F.when(odd, F.concat("file", F.lit(end))).otherwise(F.col("file")).alias("file")
    indexed = e.groupBy(named((day % 7 == 0) | ((day % 5 == 0) & n9), ".idx")).agg(F.count(F.lit(1)).alias("indexed"))
    on_disk = e.groupBy(named((day % 6 == 0) | ((day % 4 == 0) & n9), ".new")).agg(F.count(F.lit(1)).alias("on_disk"))
    return A.reconcile_index(indexed, on_disk)


@query(
    """WITH n AS (SELECT c_custkey AS k, 'spool-' || c_custkey || '.jsonl' AS file FROM customer),
fs AS (SELECT CASE WHEN k % 7 = 0 THEN 'file-' || file ELSE file END AS file, 'a' AS sha, 3 AS lines FROM n),
ms AS (SELECT CASE WHEN k % 5 = 0 THEN 'manifest-' || file ELSE file END AS file, CASE WHEN k % 3 = 0 THEN 'b' ELSE 'a' END AS m_sha, CASE WHEN k % 4 = 0 THEN 4 ELSE 3 END AS emitted, k % 11 = 0 AS malformed FROM n),
ts AS (SELECT CASE WHEN k % 2 = 1 THEN 'trace-' || file ELSE file END AS file, CASE WHEN k % 6 = 0 THEN 'b' ELSE 'a' END AS t_sha FROM n),
j AS (SELECT file, sha, m_sha, lines, emitted, t_sha, sha IS NOT NULL AS f, m_sha IS NOT NULL AS m, coalesce(malformed, false) AS bad FROM fs FULL JOIN ms USING (file) LEFT JOIN ts USING (file))
SELECT file, list_filter([CASE WHEN NOT m THEN 'SPOOL_MANIFEST_MISSING' END, CASE WHEN bad THEN 'SPOOL_MANIFEST_MALFORMED' END, CASE WHEN NOT f AND NOT bad THEN 'SPOOL_FILE_MISSING' END,
  CASE WHEN f AND m AND NOT bad AND sha <> m_sha THEN 'SPOOL_HASH_MISMATCH' END, CASE WHEN f AND m AND NOT bad AND lines <> emitted THEN 'SPOOL_COUNT_MISMATCH' END, CASE WHEN f AND m AND NOT bad AND t_sha <> m_sha THEN 'SPOOL_TRACE_MISMATCH' END], lambda x: x IS NOT NULL) AS codes FROM j""",
    lists=("codes",),
)
def spool_reconcile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    n = V.table(spark, d, "customer").select(k, F.concat(F.lit("spool-"), k.cast("string"), F.lit(".jsonl")).alias("file"))
    named = lambda odd, start: F.when(odd, F.concat(F.lit(start), "file")).otherwise(F.col("file")).alias("file")
    files = n.select(named(k % 7 == 0, "file-"), F.lit("a").alias("sha"), F.lit(3).alias("lines"))
    manifests = n.select(named(k % 5 == 0, "manifest-"), F.when(k % 3 == 0, "b").otherwise("a").alias("sha"), F.when(k % 4 == 0, 4).otherwise(3).alias("emitted"), (k % 11 == 0).alias("malformed"))
    traced = n.select(named(k % 2 == 1, "trace-"), F.when(k % 6 == 0, "b").otherwise("a").alias("sha"))
    return A.reconcile_spool(files, manifests, traced)


@query("SELECT file_path, count(*) AS n FROM traces GROUP BY file_path", "traces")
def events_per_file(spark: SparkSession, d: str) -> DataFrame:
    return V.traces(spark, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, arg_max(props, event_id) AS record, count(*) AS matches FROM events WHERE event_type = 'purchase' GROUP BY 1")
def last_record_for_date(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").filter("event_type = 'purchase'")
    return e.groupBy(F.substring(V.iso("ts"), 1, 10).alias("date")).agg(F.max_by("props", "event_id").alias("record"), F.count(F.lit(1)).alias("matches"))


# --- learning -----------------------------------------------------------------------------------

_RET = "ret AS (SELECT concept, count(*) AS total, count(*) FILTER (correct) AS correct, avg(correct::INT) AS retention, max(tested_at) AS last_tested FROM recall_results GROUP BY concept)"


@query(f"WITH {_RET} SELECT concept, total, correct, round(retention, 6) AS retention, last_tested FROM ret", "recall_results")
def retention_by_concept(spark: SparkSession, d: str) -> DataFrame:
    return N.retention_by_concept(V.recall_results(spark, d)).withColumn("retention", F.round("retention", 6))


@query(f"WITH {_RET} SELECT concept, total, correct, round(retention, 6) AS retention, last_tested FROM ret WHERE total >= 3 AND retention <= 0.95 ORDER BY ret.retention, total DESC, concept LIMIT 10", "recall_results")
def weak_areas(spark: SparkSession, d: str) -> DataFrame:
    return N.weak_areas(V.recall_results(spark, d), 3, 0.95).withColumn("retention", F.round("retention", 6))


@query(
    f"""WITH {_RET}, w AS (SELECT 'weakest' AS section, concept, total, retention FROM ret WHERE total >= 2 ORDER BY ret.retention, total DESC, concept LIMIT 5), s AS (SELECT 'strongest', concept, total, retention FROM ret WHERE total >= 2 ORDER BY ret.retention DESC, total DESC, concept LIMIT 5)
SELECT section, concept, CAST(total AS BIGINT) AS total, round(retention, 6) AS retention FROM (SELECT 'all' AS section, NULL AS concept, sum(total) AS total, sum(correct) / sum(total) AS retention FROM ret UNION ALL SELECT * FROM w UNION ALL SELECT * FROM s)""",
    "recall_results",
)
def retention_report(spark: SparkSession, d: str) -> DataFrame:
    return N.retention_report(V.recall_results(spark, d), 2).withColumn("retention", F.round("retention", 6))


@query("SELECT id, concept, correct, round(avg(correct::INT) OVER o, 6) AS retention, NOT correct AND sum((NOT correct)::INT) OVER o = 1 AS first_miss FROM recall_results WINDOW o AS (PARTITION BY concept ORDER BY ord ROWS UNBOUNDED PRECEDING)", "recall_results")
def quiz_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.running_retention(V.recall_results(spark, d)).withColumn("retention", F.round("retention", 6))


# --- cost ---------------------------------------------------------------------------------------

_COST = lambda t, m: f"((floor({t} * 0.7 + 0.5) * {_PRICE.format(m, 15, 0.8, 0.28, 3)} + ({t} - floor({t} * 0.7 + 0.5)) * {_PRICE.format(m, 75, 4, 0.42, 15)}) / 1000000)"
_PM = "CASE WHEN starts_with(lower(model), 'deepseek') THEN 'deepseek-chat' ELSE model END"


@query(f"SELECT n AS compilations, CAST(t AS BIGINT) AS total_tokens, CAST(floor(t * 0.7 + 0.5) AS BIGINT) AS input_tokens, CAST(t - floor(t * 0.7 + 0.5) AS BIGINT) AS output_tokens, round({_COST('t', chr(39) + 'claude-sonnet-4-6' + chr(39))}, 6) AS usd FROM (SELECT count(*) AS n, coalesce(sum(tokens_used), 0)::DOUBLE AS t FROM compilations)", "compilations")
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    return C.token_usage(V.compilations(spark, d)).withColumn("usd", F.round("usd", 6))


@query("SELECT type, round(avg(tokens_used), 6) AS avg_tokens, count(*) AS n FROM compilations WHERE tokens_used IS NOT NULL GROUP BY type HAVING avg(tokens_used) > 0", "compilations")
def cost_history(spark: SparkSession, d: str) -> DataFrame:
    return C.cost_history(V.compilations(spark, d)).withColumn("avg_tokens", F.round("avg_tokens", 6))


_DAY = "compiled_at >= '2024-01-01' AND compiled_at < '2024-01-02' AND tokens_used IS NOT NULL"
_SPEND = f"spend AS (SELECT model, CAST(t AS BIGINT) AS tokens, {_COST('t', _PM)} AS usd FROM (SELECT model, sum(tokens_used)::DOUBLE AS t FROM compilations WHERE {_DAY} GROUP BY model))"


@query(f"WITH {_SPEND} SELECT model, tokens, round(usd, 6) AS usd FROM spend", "compilations")
def daily_spend(spark: SparkSession, d: str) -> DataFrame:
    return C.daily_spend(V.compilations(spark, d), "2024-01-01", "2024-01-02").withColumn("usd", F.round("usd", 6))


@query(
    f"""WITH {_SPEND}, hist AS (SELECT type, avg(tokens_used) AS a FROM compilations WHERE tokens_used IS NOT NULL GROUP BY type HAVING avg(tokens_used) > 0),
line AS (SELECT type, count(*) AS n FROM (SELECT type FROM compilations WHERE stale UNION ALL SELECT 'semantic-index') GROUP BY type),
proj AS (SELECT {_COST('t', chr(39) + 'deepseek-chat' + chr(39))} AS projected FROM (SELECT sum(n * coalesce(a, CASE type WHEN 'summary' THEN 8000 WHEN 'concept' THEN 12000 WHEN 'entity' THEN 12000 WHEN 'topic' THEN 200000 WHEN 'contradiction' THEN 40000 WHEN 'open-question' THEN 40000 ELSE 50000 END)) AS t FROM line LEFT JOIN hist USING (type)))
SELECT round(projected, 6) AS projected, round(spent, 6) AS spent, round(projected + spent, 6) AS total, CASE WHEN projected + spent > 0.5 THEN 'defer' ELSE 'proceed' END AS decision FROM proj, (SELECT coalesce(sum(usd), 0) AS spent FROM spend)""",
    "compilations",
)
def cost_gate(spark: SparkSession, d: str) -> DataFrame:
    c = V.compilations(spark, d)
    affected = c.filter("stale").select("type").unionByName(spark.range(1).select(F.lit("semantic-index").alias("type")))
    g = C.cost_gate(affected, c, "2024-01-01", "2024-01-02", "deepseek-chat", 0.5)
    return g.select(*(F.round(x, 6).alias(x) for x in ("projected", "spent", "total")), "decision")


@query("SELECT lang, CAST(sum(w) AS BIGINT) AS words, CAST(sum(w) * 13 // 10 * 6 AS BIGINT) AS input_tokens, CAST((sum(w) * 13 // 10 * 6 + count(*) * 4000) * 54 // 100000 AS BIGINT) AS cents FROM (SELECT lang, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS BIGINT) AS w FROM documents) GROUP BY lang")
def budget_estimate(spark: SparkSession, d: str) -> DataFrame:
    g = V.table(spark, d, "documents").groupBy("lang").agg(F.sum(T.word_count("text")).alias("words"), F.count(F.lit(1)).alias("asks"))
    return g.selectExpr("lang", "words", "words * 13 div 10 * 6 AS input_tokens", "(words * 13 div 10 * 6 + asks * 4000) * 54 div 100000 AS cents")


@query("SELECT event_type, round(CASE WHEN base = 0 THEN NULL ELSE large / base END, 6) AS ratio, base > 0 AND large / base <= 3 AS passed FROM (SELECT event_type, avg(value) FILTER (event_id % 2 = 0) AS base, avg(value) FILTER (event_id % 2 = 1) AS large FROM events GROUP BY event_type)")
def degradation_ratio(spark: SparkSession, d: str) -> DataFrame:
    e, odd = V.table(spark, d, "events"), F.col("event_id") % 2 == 1
    g = e.groupBy("event_type").agg(F.avg(F.when(~odd, F.col("value"))).alias("base"), F.avg(F.when(odd, F.col("value"))).alias("large"))
    ratio = F.when(F.col("base") != 0, F.col("large") / F.col("base"))
    return g.select("event_type", F.round(ratio, 6).alias("ratio"), F.coalesce(ratio <= 3, F.lit(False)).alias("passed"))


# --- status, merging, sampling ------------------------------------------------------------------

_DOMAIN = "(VALUES ('source', 'pdf'), ('source', 'markdown'), ('source', 'html'), ('source', 'text'), " + ", ".join(f"('task', '{s}')" for s in V.TASK_STATUSES[:7]) + ") v(what, name)"


@query(f"SELECT what, name, (SELECT count(*) FROM sources WHERE what = 'source' AND type = name) + (SELECT count(*) FROM tasks WHERE what = 'task' AND status = name) AS n FROM {_DOMAIN}", "sources", "tasks")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.status_counts(V.sources(spark, d), V.tasks(spark, d), ("pdf", "markdown", "html", "text"), V.TASK_STATUSES[:7])


@query("SELECT status, count(*) AS n FROM tasks WHERE status LIKE 'failed_%' GROUP BY status", "tasks")
def failed_tasks(spark: SparkSession, d: str) -> DataFrame:
    return V.tasks(spark, d).filter(F.col("status").like("failed_%")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT id, status, floor((epoch(TIMESTAMP '2024-06-01') - epoch(strptime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ'))) / 3600 * 10 + 0.5) / 10 AS age_hours, coalesce(own, 0) AS transitions, (SELECT count(*) FROM events) AS transitions_shown
FROM tasks LEFT JOIN (SELECT 't' || user_id AS id, count(*) AS own FROM events GROUP BY 1) USING (id)""",
    "tasks",
)
def task_status_view(spark: SparkSession, d: str) -> DataFrame:
    moves = V.table(spark, d, "events").select(V.key("t", "user_id").alias("id"))
    return M.task_view(V.tasks(spark, d), moves, "2024-06-01T00:00:00Z")


_NT = "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_MP = "mp AS (SELECT substring(headline, 1, 8) AS title, text AS page, ['s' || (ord % 90), 's' || (ord % 7)] AS ids, ord FROM wiki)"


@query(
    f"""WITH {_MP}, k AS (SELECT *, {_NT} AS key FROM mp), best AS (SELECT key, arg_max(title, (length(page), -ord)) AS title, arg_max(page, (length(page), -ord)) AS page, min(ord) AS first_ord FROM k GROUP BY key),
one AS (SELECT key, x, min((ord, p)) AS place FROM (SELECT key, ord, unnest(ids) AS x, generate_subscripts(ids, 1) AS p FROM k) GROUP BY key, x)
SELECT key, title, sha256(page) AS digest, first_ord, ids FROM best JOIN (SELECT key, list(x ORDER BY place) AS ids FROM one GROUP BY key) USING (key)""",
    "wiki",
    lists=("ids",),
)
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("ord")
    pages = V.wiki(spark, d).select(F.substring("headline", 1, 8).alias("title"), F.col("text").alias("page"), F.array(V.key("s", k % 90), V.key("s", k % 7)).alias("ids"), k)
    return M.merge_pages(pages).select("key", "title", F.sha2("page", 256).alias("digest"), "first_ord", "ids")


@query("SELECT lang, count(id) AS entries, count(DISTINCT batch) AS batches, count(DISTINCT batch) FILTER (id IS NOT NULL) AS with_entries, count(DISTINCT batch) >= 2 AND count(DISTINCT batch) FILTER (id IS NOT NULL) >= 2 AS reduce FROM (SELECT lang, doc_id // 25 AS batch, CASE WHEN doc_id % 50 < 25 THEN doc_id END AS id FROM documents) GROUP BY lang")
def batch_digest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = V.table(spark, d, "documents").select("lang", F.floor(k / 25).alias("batch"), F.when(k % 50 < 25, k).alias("id"))
    return M.batch_digest(rows, "lang")


@query("SELECT id, output_path, compiled_at FROM compilations WHERE NOT stale AND starts_with(output_path, 'wiki/topics/') AND id IN (SELECT compilation_id FROM compilation_sources) ORDER BY compiled_at DESC, id LIMIT 10", "compilations", "compilation_sources")
def sample_compilations(spark: SparkSession, d: str) -> DataFrame:
    t = V.compilation_sources(spark, d).select(F.col("compilation_id").alias("id"))
    return M.sample_compilations(V.compilations(spark, d), t, 10, "topics").select("id", "output_path", "compiled_at")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
c AS (SELECT key, event_id, ms, n, true AS accepted, ms AS last FROM e WHERE n = 1
  UNION ALL SELECT e.key, e.event_id, e.ms, e.n, e.ms - c.last >= 7200000, CASE WHEN e.ms - c.last >= 7200000 THEN e.ms ELSE c.last END FROM c JOIN e ON e.key = c.key AND e.n = c.n + 1)
SELECT key, event_id, ms, accepted FROM c"""
)
def debounce(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("ms"))
    return M.debounce(e, 7_200_000)


@query(
    f"""WITH st AS ({_STALE}), {_LINKS}
SELECT v.valid, v.invalid, (SELECT count(*) FROM st) AS stale, u.n AS uncompiled, o.n AS orphans, v.invalid + (SELECT count(*) FROM st) + u.n + o.n AS issues
FROM (SELECT count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid FROM ({SCHEMA_SQL})) v,
  (SELECT count(*) AS n FROM sources s WHERE NOT EXISTS (SELECT 1 FROM compilations c WHERE c.source_id = s.id AND c.type = 'summary')) u,
  (SELECT count(*) AS n FROM wiki WHERE dir <> 'sources' AND slug NOT IN (SELECT trim(split_part(link, '|', 1)) FROM edges)) o""",
    "wiki", "compilations", "sources",
)
def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    w, s, c = V.wiki(spark, d), V.sources(spark, d), V.compilations(spark, d)
    valid = schema_pages(spark, d).select((F.size("errors") == 0).alias("valid"))
    return M.lint_summary(valid, L.stale_pages(c, s), L.uncompiled_sources(s, c), L.orphan_pages(w))


_U5 = "substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (instr('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12)"


SPOOL_SQL = f"""SELECT path, reject, CASE WHEN reject IS NULL THEN {_U5} END AS id, CASE WHEN reject IS NULL THEN CASE WHEN type = 'open-question' THEN 'Open question: ' ELSE '' END || t END AS title,
  CASE WHEN reject IS NULL THEN CASE type WHEN 'concept' THEN 'pattern' WHEN 'topic' THEN 'architecture' WHEN 'contradiction' THEN 'troubleshooting' ELSE 'reference' END END AS category
FROM (SELECT path, type, CASE WHEN trim(title) = '' THEN slug ELSE title END AS t, sha1(unhex('{T.PAGE_NAMESPACE.replace('-', '')}') || encode('ws' || chr(0) || path || chr(0) || sha256(b))) AS h,
  CASE WHEN type IS NULL OR type = 'poster' THEN 'MISSING_TYPE' WHEN type = 'semantic-index' THEN 'SEMANTIC_INDEX_SKIPPED' WHEN b = '' THEN 'EMPTY_CONTENT' WHEN strlen(b) > 65536 THEN 'CONTENT_TOO_LARGE' END AS reject
  FROM (SELECT path, slug, CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 11 = 0 THEN 'semantic-index' WHEN ord % 17 = 0 THEN 'poster' ELSE type END AS type, CASE WHEN ord % 4 = 0 THEN ' ' ELSE title END AS title,
    regexp_replace(CASE WHEN ord % 9 = 0 THEN ' ' ELSE body END, '^\\s+|\\s+$', '', 'g') AS b FROM wiki))"""


@query(SPOOL_SQL, "wiki")
def spool_emit(spark: SparkSession, d: str) -> DataFrame:
    return spool_candidates(spool_pages(spark, d), "ws").drop("content", "tags")


def spool_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("ord")
    kind = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "semantic-index").when(k % 17 == 0, "poster").otherwise(F.col("type"))
    return V.wiki(spark, d).select("path", kind.alias("type"), F.when(k % 4 == 0, " ").otherwise(F.col("title")).alias("title"), F.when(k % 9 == 0, " ").otherwise(F.col("body")).alias("body"), F.array("tags").alias("tags"))


# --- evaluations --------------------------------------------------------------------------------

_SPECS = """bt AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
specs AS (SELECT item_id AS spec_id, term FROM bt QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) <= 4)"""
_MANY = Q._PAGES + ", " + _SPECS + """,
tot AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM toks),
tf AS (SELECT path, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM plain WHERE term IN (SELECT term FROM specs) GROUP BY path, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT path, term, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))) AS w FROM tf JOIN dfs USING (term), tot),
ranked AS (SELECT spec_id, path, -sum(w) AS rank FROM specs JOIN w USING (term) GROUP BY spec_id, path),
top AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY round(rank, 9), path) <= 10)"""


def _specs(spark: SparkSession, d: str) -> DataFrame:
    terms = V.table(spark, d, "benchmark").select(F.col("item_id").alias("spec_id"), F.explode(F.array_distinct(S.tokens("text"))).alias("term"))
    nth = F.row_number().over(W.partitionBy("spec_id").orderBy(F.desc(F.length("term")), "term"))
    return terms.withColumn("nth", nth).filter("nth <= 4").drop("nth")


def _longest(spark: SparkSession, d: str) -> DataFrame:
    """spec_id, path of the pages that have a passage's longest term."""
    nth = F.row_number().over(W.partitionBy("spec_id").orderBy(F.desc(F.length("term")), "term"))
    first = _specs(spark, d).withColumn("nth", nth).filter("nth = 1").select("spec_id", "term")
    i = Q.index(spark, d)
    return first.join(S.of_terms(i.postings, first, i.buckets).select("path", "term"), "term").select("spec_id", "path")


@query(
    "WITH " + _MANY + """, want AS (SELECT DISTINCT spec_id, path FROM (SELECT spec_id, term FROM specs QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY length(term) DESC, term) = 1) JOIN plain USING (term)),
h AS (SELECT spec_id, count(*) AS hits FROM top GROUP BY 1), g AS (SELECT spec_id, count(*) AS good FROM top JOIN want USING (spec_id, path) GROUP BY 1), n AS (SELECT spec_id, count(*) AS wanted FROM want GROUP BY 1),
s AS (SELECT spec_id, coalesce(good, 0) / wanted AS recall, CASE WHEN coalesce(hits, 0) > 0 THEN coalesce(good, 0) / least(10, hits) ELSE 0 END AS precision FROM n LEFT JOIN h USING (spec_id) LEFT JOIN g USING (spec_id))
SELECT spec_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round((recall + precision) / 2, 6) AS score, (recall + precision) / 2 >= 0.5 AS passed FROM s""",
    "wiki",
)
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    found = E.search_many(Q.pages(spark, d), _specs(spark, d), 10, index=Q.index(spark, d))
    out = E.retrieval_scores(found, _longest(spark, d), 10, 0.5)
    return out.select("spec_id", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "score")), "passed")


@query(
    "WITH " + _MANY + """, ph AS (SELECT item_id AS spec_id, unnest([text, split_part(text, ' ', 1), 'zz no such phrase']) AS phrase FROM benchmark),
hit AS (SELECT spec_id, phrase, bool_or(coalesce(contains(lower(body), lower(phrase)), false)) AS hit FROM ph LEFT JOIN top USING (spec_id) LEFT JOIN pages_ USING (path) GROUP BY 1, 2)
SELECT spec_id, round(avg(hit::INT), 6) AS grounding FROM hit GROUP BY spec_id""",
    "wiki",
)
def functional_quality_eval(spark: SparkSession, d: str) -> DataFrame:
    p = Q.pages(spark, d)
    phrases = V.table(spark, d, "benchmark").select(F.col("item_id").alias("spec_id"), F.explode(F.array("text", F.substring_index("text", " ", 1), F.lit("zz no such phrase"))).alias("phrase"))
    out = E.grounding_scores(E.search_many(p, _specs(spark, d), 10, index=Q.index(spark, d)), p.select("path", F.col("body").alias("text")), phrases)
    return out.select("spec_id", F.round("grounding", 6).alias("grounding"))


_RES = """tt AS (SELECT lower(trim(title)) AS k, arg_max(path, ord) AS target FROM wiki GROUP BY 1), ss AS (SELECT lower(slug) AS k, arg_max(path, ord) AS target FROM wiki GROUP BY 1),
res AS (SELECT c.path, 'source' AS kind, ref, coalesce(target, '') AS target FROM (SELECT path, trim(unnest(regexp_extract_all(body, '\\[source:[ \\t]*([^\\]]+)\\]', 1))) AS ref FROM wiki) c LEFT JOIN tt ON tt.k = lower(ref)
  UNION ALL SELECT c.path, 'link', ref, coalesce(target, '') FROM (SELECT path, trim(split_part(unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)), '|', 1)) AS ref FROM wiki) c LEFT JOIN ss ON ss.k = lower(ref) WHERE ref <> '')"""


@query(f"WITH {_RES} SELECT * FROM res", "wiki")
def citation_resolve(spark: SparkSession, d: str) -> DataFrame:
    return E.resolve_citations(V.wiki(spark, d))


@query(f"WITH {_RES} SELECT path, count(*) AS total, count(*) FILTER (target <> '') AS verified, round(avg((target <> '')::INT), 6) AS score FROM res GROUP BY path", "wiki")
def citation_eval(spark: SparkSession, d: str) -> DataFrame:
    return E.citation_scores(E.resolve_citations(V.wiki(spark, d))).withColumn("score", F.round("score", 6))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 3 THEN CAST(CASE WHEN quality = 1 THEN doc_id % 4 ELSE doc_id % 4 // 2 END AS BIGINT) END AS supported, CASE WHEN doc_id % 7 <> 3 THEN CAST(doc_id % 4 AS BIGINT) END AS total, CASE WHEN doc_id % 7 <> 3 THEN CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE round((CASE WHEN quality = 1 THEN doc_id % 4 ELSE doc_id % 4 // 2 END) / (doc_id % 4), 6) END END AS score FROM labels")
def faithfulness_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    n = k % 4
    good = F.when(F.col("quality") == 1, n).otherwise(F.floor(n / 2))
    claims = F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.concat(F.lit('{"claim":"c","supported":'), (i <= good).cast("string"), F.lit("}")))
    listed = F.when(n == 0, "").otherwise(F.array_join(claims, ","))
    response = F.when(k % 7 == 3, "no judgement").otherwise(F.concat(F.lit('```json\n{"claims":['), listed, F.lit('],"summary":"s"}\n```')))
    return E.faithfulness(V.table(spark, d, "labels").select(k.alias("id"), response.alias("response"))).withColumn("score", F.round("score", 6))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 9 NOT IN (0, 4) THEN round((doc_id % 5 + 1 + 3 + (doc_id // 5) % 5 + 1) / 3.0 / 5, 4) END AS score FROM labels")
def compilation_rubric(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    s = lambda name, v: F.struct(F.lit(name).alias("criterion"), v.cast("double").alias("score"))
    full = F.array(s("accuracy", k % 5 + 1), s("clarity", F.when(k % 9 == 4, 6).otherwise(3)), s("coverage", F.floor(k / 5) % 5 + 1))
    rows = V.table(spark, d, "labels").select(k.alias("id"), F.when(k % 9 == 0, F.slice(full, 1, 2)).otherwise(full).alias("scores"))
    return E.rubric(rows, ["accuracy", "clarity", "coverage"])


@query("SELECT event_type AS type, count(*) AS total, count(*) FILTER (s >= 0.5) AS passed, count(*) FILTER (s < 0.5) AS failed, round(avg(s), 6) AS mean_score FROM (SELECT event_type, CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE (event_id % 11) / 10.0::DOUBLE END AS s FROM events) GROUP BY event_type")
def eval_batch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    r = V.table(spark, d, "events").select(F.col("event_type").alias("type"), F.when(k % 50 != 0, (k % 11) / 10).alias("score"), F.lit(0.5).alias("threshold"))
    return E.eval_totals(r).withColumn("mean_score", F.round("mean_score", 6))


_JUDGED = """ans AS (SELECT doc_id AS id, doc_id // 5 AS intent, CASE WHEN doc_id % 6 <> 0 THEN 'wiki/' || (doc_id * 3 % 1500) END AS cited, [split_part(text, '.', 1), split_part(text, ' ', 1), 'qqq'] AS phrases FROM documents),
src AS (SELECT 'wiki/' || doc_id AS cited, text FROM documents), jd AS (SELECT id, intent, cited, text, len(list_filter(phrases, lambda p: contains(lower(text), lower(p)))) / 3.0 AS share FROM ans LEFT JOIN src USING (cited)),
vd AS (SELECT id, intent, CASE WHEN cited IS NULL THEN 'CHALLENGED' WHEN text IS NULL OR share = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verdict, share FROM jd)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = V.table(spark, d, "documents")
    answers = docs.select(k.alias("id"), F.when(k % 6 != 0, V.key("wiki/", k * 3 % 1500)).alias("cited"), F.array(F.substring_index("text", ".", 1), F.substring_index("text", " ", 1), F.lit("qqq")).alias("phrases"))
    return E.verdicts(answers, docs.select(V.key("wiki/", k).alias("path"), "text"))


@query(f"WITH {_JUDGED} SELECT id, verdict, round(CASE WHEN verdict = 'VERIFIED' THEN share ELSE 0 END, 6) AS score FROM vd")
def receipt_verify(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_JUDGED} SELECT intent, count(*) FILTER (verdict = 'VERIFIED') AS verified, count(*) FILTER (verdict = 'CHALLENGED') AS challenged, count(*) FILTER (verdict = 'UNVERIFIED') AS unverified, round(count(*) FILTER (verdict = 'VERIFIED') / count(*), 6) AS verify_rate, bool_and(verdict = 'VERIFIED') AS robust FROM vd GROUP BY intent")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return E.scorecard(_judged(spark, d).withColumn("intent", F.floor(F.col("id") / 5))).withColumn("verify_rate", F.round("verify_rate", 6))


_CW = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9-]{{2,}}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in S.SEARCH_STOP_WORDS) + ")))"


@query(f"SELECT doc_id, round(CASE WHEN len(tw) = 0 THEN 1.0 ELSE len(list_intersect(tw, sw)) / len(tw) END, 6) AS overlap, CASE WHEN len(tw) = 0 OR len(list_intersect(tw, sw)) / len(tw) >= 0.5 THEN 1 ELSE 0 END AS score FROM (SELECT d.doc_id, {_CW.format('d.text')} AS tw, {_CW.format("coalesce(s.text, '')")} AS sw FROM documents d LEFT JOIN documents s ON s.doc_id = d.doc_id + 1)")
def overlap_grounding(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("source")), "doc_id", "left")
    o = E.overlap(F.col("text"), F.coalesce("source", F.lit("")))
    return pairs.select("doc_id", F.round(o, 6).alias("overlap"), F.when(o >= E.GROUNDED, 1).otherwise(0).alias("score"))


@query("SELECT doc_id, CASE WHEN h = 3 THEN 'PASS' WHEN h > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS grade FROM (SELECT doc_id, len(list_filter(['the', 'licen', '@'], lambda p: contains(lower(text), p))) AS h FROM documents)")
def substring_grade(spark: SparkSession, d: str) -> DataFrame:
    phrases = F.array(*map(F.lit, ("the", "licen", "@")))
    return V.table(spark, d, "documents").select("doc_id", E.substring_grade(phrases, F.col("text")).alias("grade"))


@query(f"WITH {_RET} SELECT concept AS name, CASE WHEN ascii(right(concept, 1)) % 5 = 0 THEN 'recorded' WHEN retention < 0.85 THEN 'regression' WHEN retention < 0.9 THEN 'warning' ELSE 'pass' END AS status FROM ret", "recall_results")
def floor_gate(spark: SparkSession, d: str) -> DataFrame:
    scores = N.retention_by_concept(V.recall_results(spark, d)).select(F.col("concept").alias("name"), F.col("retention").alias("score"))
    other = F.ascii(F.right("name", F.lit(1))) % 5 == 0
    floors = scores.select(F.when(other, F.concat(F.lit("other "), "name")).otherwise(F.col("name")).alias("name"), F.lit(0.85).alias("floor"))
    return E.floor_gate(scores, floors, 0.9)
