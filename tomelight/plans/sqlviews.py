"""The relations of ``views.py`` as SQL, to put before a query's own SQL."""

from __future__ import annotations

from ..views import COMPILATION_TYPES, PAGE_TYPES, TASK_STATUSES, WIKI_DIRS


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def minutes(m: str) -> str:
    return f"strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST({m} AS BIGINT)), '%Y-%m-%dT%H:%M:00.000Z')"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def words(text: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({text}, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS BIGINT)"


_DIR = f"{_list(WIKI_DIRS)}[doc_id % 6 + 1]"
_KIND = f"{_list(COMPILATION_TYPES)}[doc_id % 6 + 1]"
_PATH = f"'wiki/' || {_DIR} || '/p' || doc_id || '.md'"

VIEWS = {
    "sources": f"""SELECT 's' || doc_id AS id, 'raw/notes/n' || (doc_id % 700) || '.md' AS path, source AS mount_id,
      CASE WHEN doc_id % 10 = 0 THEN 'html' WHEN doc_id % 10 = 1 THEN 'text' ELSE 'markdown' END AS type,
      'Note ' || doc_id AS title, {minutes("doc_id")} AS ingested_at, {words("text")} AS word_count, sha256(text) AS hash, doc_id AS ord
      FROM documents""",
    "compilations": f"""SELECT 'c' || doc_id AS id, CASE WHEN doc_id % 6 IN (0, 1, 3) THEN 's' || doc_id END AS source_id, {_KIND} AS type, {_PATH} AS output_path,
      {minutes("greatest(doc_id + CASE doc_id % 3 WHEN 0 THEN -30 WHEN 1 THEN 30 ELSE 60 END, 0)")} AS compiled_at, toxic = 1 AS stale,
      CASE lang WHEN 'en' THEN 'claude-sonnet-4-6' WHEN 'de' THEN 'claude-haiku-4-5' WHEN 'fr' THEN 'deepseek-v4-flash' ELSE 'claude-opus-4-6' END AS model,
      CASE WHEN doc_id % 7 <> 0 THEN CAST(ceil(n_chars / 4.0) AS BIGINT) END AS tokens_used, doc_id AS ord
      FROM documents JOIN labels USING (doc_id)""",
    "compilation_sources": """SELECT CASE WHEN ord % 5 = 0 THEN 'gone' || ord ELSE id END AS compilation_id, 's' || (ord + j) AS source_id FROM compilations, (VALUES (0), (1), (5)) v(j) WHERE source_id IS NULL""",
    "recall_results": f"""SELECT 'r' || doc_id AS id, source AS concept, lang AS topic, quality = 1 AS correct, {minutes("doc_id")} AS tested_at,
      (doc_id % 11) / 10.0::DOUBLE AS confidence, CASE WHEN doc_id % 5 <> 0 THEN 'card-' || (doc_id % 20) END AS source_card, doc_id AS ord
      FROM documents JOIN labels USING (doc_id)""",
    "traces": f"""SELECT 'e' || event_id AS id, event_type, CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id END AS correlation_id, {iso("ts")} AS timestamp,
      'audit/traces/' || strftime(ts, '%Y-%m-%d') || '.jsonl' AS file_path, event_id AS line_offset FROM events""",
    "trace_lines": """SELECT file, line_no,
      CASE WHEN ord % 997 = 0 THEN line || ' ' WHEN ord % 1999 = 5 THEN 'not json' ELSE line END AS raw,
      sha256(CASE WHEN line_no > 1 THEN before WHEN substring(file, 10, 1) IN ('4', '8') THEN NULL ELSE day_before END) AS prev_hash,
      ord % 997 = 0 OR ord % 1999 <> 5 AS parses, ord
      FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS line_no, lag(line) OVER (PARTITION BY file ORDER BY ord) AS before
            FROM (SELECT strftime(ts, '%Y-%m-%d') || '.jsonl' AS file, event_id AS ord,
                         '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user":' || user_id || '}' AS line FROM events))
      JOIN (SELECT file, lag(last) OVER (ORDER BY file) AS day_before
            FROM (SELECT strftime(ts, '%Y-%m-%d') || '.jsonl' AS file,
                         max_by('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user":' || user_id || '}', event_id) AS last FROM events GROUP BY 1)) USING (file)""",
    "tasks": f"""SELECT 't' || o_orderkey AS id, o_orderpriority AS brief, {_list(TASK_STATUSES)}[o_orderkey % 11 + 1] AS status, {iso("o_orderdate")} AS created_at, o_custkey AS owner, o_orderkey AS ord FROM orders""",
    "wiki": f"""SELECT {_PATH} AS path, {_DIR} AS dir, 'p' || doc_id AS slug, {_list(PAGE_TYPES)}[doc_id % 6 + 1] AS type, 'Page ' || doc_id AS title,
      substring(replace(text, chr(10), ' '), 1, 40) AS headline, lang AS tags,
      text || chr(10) || 'See [[p' || (doc_id * 7 % 1500) || ']] and [[P' || (doc_id * 13 % 1500) || '|other]] [source: Page ' || (doc_id * 3 % 1500) || '].' AS body,
      text, doc_id AS ord FROM documents""",
    "raw_pages": """SELECT path, dir, slug, ord, type, CASE WHEN ord % 11 = 0 THEN text ELSE
      '---' || chr(10) || 'title: ' || CASE WHEN ord % 2 = 0 THEN '"' || title || '"' ELSE title END || chr(10) || 'type: ' || type || chr(10) ||
      CASE ord % 3 WHEN 0 THEN 'tags: [alpha, ''beta'', gamma]' || chr(10) WHEN 1 THEN 'tags:' || chr(10) || '  - alpha' || chr(10) || '  - "beta"' || chr(10) ELSE '' END ||
      CASE WHEN ord % 4 = 0 THEN 'source_ids: [s' || ord || ', s' || (ord + 1) || ']' || chr(10) ELSE '' END ||
      'url: http://x.example:80/' || slug || chr(10) || '---' || chr(10) || chr(10) || text END AS raw FROM wiki""",
    "promotions": f"""SELECT 'pr' || doc_id AS id, 'outputs/reports/r' || doc_id || '.md' AS source_path, CASE WHEN doc_id % 9 = 0 THEN {_PATH} ELSE 'wiki/' || {_DIR} || '/q' || doc_id || '.md' END AS target_path, {minutes("doc_id")} AS promoted_at, doc_id AS ord FROM documents""",
    "artifacts": f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'outputs/reports/r' ELSE 'outputs/slides/r' END || doc_id || '.md' AS path,
      CASE WHEN doc_id % 21 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'report' WHEN doc_id % 33 = 0 THEN 'poster' ELSE 'slides' END AS type,
      CASE WHEN doc_id % 15 = 0 THEN '  ' WHEN doc_id % 27 = 0 THEN NULL ELSE 'Artifact ' || doc_id END AS title,
      CASE WHEN doc_id % 24 = 0 THEN 'not a date' ELSE {minutes("doc_id")} END AS generated_at,
      CASE WHEN doc_id % 18 <> 0 THEN ['s' || doc_id, 's' || (doc_id + 1)] END AS generated_from, 'm1' AS model,
      CASE WHEN doc_id % 12 <> 0 THEN n_chars::DOUBLE / CASE WHEN doc_id % 30 = 0 THEN 7 ELSE 1 END END AS tokens_used,
      doc_id % 5 <> 0 AS marp, CASE WHEN doc_id % 6 = 0 THEN ['p' || doc_id] END AS source_pages, doc_id AS ord
      FROM documents""",
    "answers": """SELECT conv_id * 10 + turn AS answer_id,
      replace(text, chr(10), ' ') || ' [source: Page ' || ((conv_id * 10 + turn) % 1300) || ']' || chr(13) || chr(10) || 'Second  claim [source:' || chr(9) || 'page ' || ((conv_id * 10 + turn) * 3 % 2600) ||
      '] again [source: PAGE ' || ((conv_id * 10 + turn) * 3 % 2600) || ' ]' || chr(160) || chr(10) || chr(9) || 'No claim. [source: Page 0] [source: ]' || chr(10) ||
      replace(text, chr(10), ' ') || ' [source: page ' || ((conv_id * 10 + turn) % 1300) || ']  ' AS text
      FROM conversations WHERE role = 'assistant'""",
}
NEEDS = {"compilation_sources": ["compilations"], "raw_pages": ["wiki"]}


def sql(body: str, *views: str) -> str:
    """``body`` with the views it names before it; ``body`` may start with a list of its own (``, x AS (...)``)."""
    names: list[str] = []
    for v in views:
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    body = body.strip()
    if body.startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
