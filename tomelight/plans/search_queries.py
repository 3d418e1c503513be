"""Full-text queries.  Question terms come from the corpus itself: words of middling frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators import match as M
from ..operators import search as S
from ..storage import exists, listing, new_path
from .registry import query

N_TERMS, LEAST_DF = 3, 5

_TOK = "regexp_extract_all(lower(concat_ws(' ', title, tags, body)), '[a-z0-9]+')"
_PAGES = """pages_ AS (SELECT path, type, headline AS title, tags, text AS body FROM wiki),
toks AS (SELECT path, """ + _TOK + """ AS ts FROM pages_),
plain AS (SELECT path, len(ts) AS doc_len, unnest(ts) AS term FROM toks),
freq AS (SELECT term, count(DISTINCT path) AS df FROM plain GROUP BY term),
terms AS (SELECT term FROM freq WHERE df >= 5 AND length(term) >= 5 ORDER BY df, term LIMIT 3)"""
_BM25 = _PAGES + """,
tot AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM toks),
tf AS (SELECT path, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM plain JOIN terms USING (term) GROUP BY path, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ranked AS (SELECT path, -sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
    * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len)))) AS rank, count(*) AS matched
    FROM tf JOIN dfs USING (term), tot GROUP BY path)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    return V.wiki(spark, d).select("path", "type", F.col("headline").alias("title"), "tags", F.col("text").alias("body"))


_indexes: dict[tuple, str] = {}


def index(spark: SparkSession, d: str, stem: bool = False) -> S.Index:
    """The pages' stored index, written for the first question about a table as it is."""
    source = f"{d}/documents.parquet"
    name = (spark.sparkContext.applicationId, source, listing(spark, source), stem)
    # The totals are written last; a shared folder may be emptied between questions.
    if name not in _indexes or not exists(spark, f"{_indexes[name]}/totals/_SUCCESS"):
        path = new_path(spark, "index")
        S.write_index(pages(spark, d), path, stem=stem)
        _indexes[name] = path
    return S.read_index(spark, _indexes[name])


def corpus_terms(stored: S.Index) -> DataFrame:
    """The rarest terms that at least ``LEAST_DF`` pages have, five characters and up."""
    freq = stored.terms.filter((F.col("df") >= LEAST_DF) & (F.length("term") >= 5))
    return freq.orderBy("df", "term").limit(N_TERMS).select("term", "df")


@query("WITH " + _PAGES + " SELECT term, count(DISTINCT path) AS df, count(*) AS total_tf FROM plain GROUP BY term", "wiki")
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).terms.select("term", "df", "total_tf")


@query("WITH " + _BM25 + " SELECT path, round(rank, 6) AS rank, matched FROM ranked ORDER BY round(rank, 9), path LIMIT 20", "wiki")
def fts_search_bm25(spark: SparkSession, d: str) -> DataFrame:
    p, i = pages(spark, d), index(spark, d)
    return S.search(p, corpus_terms(i), 20, match_all=False, index=i).select("path", F.round("rank", 6).alias("rank"), "matched")


_RERANK = """,
best AS (SELECT * FROM ranked ORDER BY round(rank, 9), path LIMIT 60),
boost AS (SELECT path, type, rank, rank - CASE WHEN EXISTS (SELECT 1 FROM terms WHERE contains(lower(title), term)) THEN 0.5 ELSE 0.0 END
    - CASE WHEN type IN ('topic', 'concept') THEN 0.3 ELSE 0.0 END AS adjusted FROM best JOIN pages_ USING (path))"""


@query("WITH " + _BM25 + _RERANK + " SELECT path, type, round(rank, 6) AS rank, round(adjusted, 6) AS adjusted FROM boost ORDER BY round(adjusted, 9), round(rank, 9), path LIMIT 20", "wiki")
def relevant_pages_rerank(spark: SparkSession, d: str) -> DataFrame:
    p, i = pages(spark, d), index(spark, d)
    found = S.rerank(p, corpus_terms(i), "analytical", 20, match_all=False, index=i)
    return found.select("path", "type", F.round("rank", 6).alias("rank"), F.round("adjusted", 6).alias("adjusted"))


_STRICT = """,
flagged AS (SELECT *, matched = (SELECT count(*) FROM terms) AS strict FROM ranked),
chosen AS (SELECT * FROM flagged WHERE strict OR NOT (SELECT coalesce(bool_or(strict), false) FROM flagged))"""


@query("WITH " + _BM25 + _STRICT + " SELECT path, round(rank, 6) AS rank, matched, strict FROM chosen ORDER BY round(rank, 9), path LIMIT 10", "wiki")
def strict_then_broad(spark: SparkSession, d: str) -> DataFrame:
    p, i = pages(spark, d), index(spark, d)
    return S.strict_then_broad(p, corpus_terms(i), index=i).select("path", F.round("rank", 6).alias("rank"), "matched", "strict")


@query(
    "WITH " + _BM25 + _STRICT + """,
strict_best AS (SELECT path, rank FROM ranked WHERE matched = (SELECT count(*) FROM terms) ORDER BY round(rank, 9), path LIMIT 15),
boosted AS (SELECT path, rank - CASE WHEN EXISTS (SELECT 1 FROM terms WHERE contains(lower(title), term)) THEN 0.5 ELSE 0.0 END
    - CASE WHEN type IN ('source-summary', 'entity') THEN 0.3 ELSE 0.0 END AS adjusted, rank FROM strict_best JOIN pages_ USING (path)),
top5 AS (SELECT path, adjusted AS rank, 'boosted' AS origin FROM boosted ORDER BY round(adjusted, 9), round(rank, 9), path LIMIT 5),
plain5 AS (SELECT path, rank, 'analysis' AS origin FROM chosen ORDER BY round(rank, 9), path LIMIT 5)
SELECT path, round(rank, 6) AS rank, origin FROM top5 UNION ALL SELECT path, round(rank, 6), origin FROM plain5 WHERE NOT EXISTS (SELECT 1 FROM top5)""",
    "wiki",
)
def ask_page_selection(spark: SparkSession, d: str) -> DataFrame:
    p, i = pages(spark, d), index(spark, d)
    return S.ask_pages(p, corpus_terms(i), "factual", index=i).select("path", F.round("rank", 6).alias("rank"), "origin")


@query(
    "WITH " + _BM25 + """,
top10 AS (SELECT path, row_number() OVER (ORDER BY round(rank, 9), path) AS n FROM (SELECT * FROM ranked ORDER BY round(rank, 9), path LIMIT 10))
SELECT path, lpad(n::VARCHAR, 2, '0') || '-' || regexp_replace(regexp_replace(regexp_replace(path, '\\.md$', ''), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.md' AS filename,
  CASE WHEN length(body) > 1000 THEN substring(body, 1, 1000) || chr(10) || chr(10) || '[...truncated...]' ELSE body END AS excerpt
FROM top10 JOIN pages_ USING (path)""",
    "wiki",
)
def evidence_collect(spark: SparkSession, d: str) -> DataFrame:
    p, i = pages(spark, d), index(spark, d)
    return S.evidence(p, corpus_terms(i), 10, 1000, index=i)


@query(None)
def fts_search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """As the search above, over folded and stemmed terms."""
    i = index(spark, d, stem=True)
    return S.search(pages(spark, d), corpus_terms(i), 20, match_all=False, index=i).select("path", F.round("rank", 6).alias("rank"), "matched")


_COLS = """cols AS (SELECT path, generate_subscripts([1, 2, 3], 1) AS c, unnest([regexp_extract_all(lower(title), '[a-z0-9]+'), regexp_extract_all(lower(tags), '[a-z0-9]+'), regexp_extract_all(lower(body), '[a-z0-9]+')]) AS ts FROM pages_),
at_ AS (SELECT path, c, generate_subscripts(ts, 1) AS p, unnest(ts) AS t FROM cols)"""


@query(
    "WITH " + _PAGES + ", " + _COLS + """, ph AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+')[1:6] AS ws FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0),
win AS (SELECT path, t, array_to_string([t, lead(t, 1) OVER w, lead(t, 2) OVER w, lead(t, 3) OVER w, lead(t, 4) OVER w, lead(t, 5) OVER w], ' ') AS s FROM at_ WINDOW w AS (PARTITION BY path, c ORDER BY p))
SELECT id, path, count(*) AS hits FROM ph JOIN win ON t = ws[1] AND (s = array_to_string(ws, ' ') OR starts_with(s, array_to_string(ws, ' ') || ' ')) GROUP BY id, path""",
    "wiki",
)
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Which pages have the first six words of each passage in a row, and how often."""
    phrases = V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.slice(S.tokens("text"), 1, 6).alias("terms"))
    return M.phrase_hits(index(spark, d), phrases)


@query(
    "WITH " + _PAGES + ", " + _COLS + """,
t3 AS (SELECT list(term ORDER BY df, term) AS x FROM (SELECT term, df FROM freq WHERE df >= 5 AND length(term) >= 5 ORDER BY df, term LIMIT 3)),
has AS (SELECT path, c, p, t, x, lead(t) OVER (PARTITION BY path, c ORDER BY p) AS nxt FROM at_, t3),
per AS (SELECT path, bool_or(t = x[1]) AS a, bool_or(t = x[2]) AS b, bool_or(starts_with(t, x[3][1:3])) AS pre, bool_or(c = 1 AND p = 1 AND t = 'the') AS first_the, bool_or(c = 2 AND t = 'en') AS en,
  bool_or(c = 3 AND t = 'the') AS body_the, bool_or(t = 'of' AND nxt = 'the') AS of_the FROM has GROUP BY path),
near_ AS (SELECT DISTINCT u.path FROM (SELECT path, c, p FROM has WHERE t = x[1]) u JOIN (SELECT path, c, p FROM at_ WHERE t = 'the') v ON u.path = v.path AND u.c = v.c AND abs(u.p - v.p) <= 4)
SELECT 'either' AS what, path FROM per WHERE a OR (b AND of_the) UNION ALL SELECT 'without', path FROM per WHERE en AND NOT pre AND NOT body_the
UNION ALL SELECT 'start', path FROM per WHERE first_the OR a UNION ALL SELECT 'near', path FROM near_""",
    "wiki",
)
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    """Expressions with words of the corpus: boolean, column, prefix, first word and nearness."""
    i = index(spark, d)
    a, b, c = (r["term"] for r in corpus_terms(i).orderBy("df", "term").collect())
    asked = {"either": f'{a} OR ({b} AND "of the")', "without": f"tags : en NOT {c[:3]}* NOT body : the", "start": f"title : ^the OR {a}", "near": f"NEAR({a} the, 3)"}
    found = [M.match_pages(i, text).select(F.lit(what).alias("what"), "path") for what, text in asked.items()]
    return reduce(DataFrame.unionByName, found)


@query(None)
def fts_snippet(spark: SparkSession, d: str) -> DataFrame:
    """The best pages for any of three words of the corpus, with the part of their text that shows most of them."""
    i = index(spark, d)
    terms = [r["term"] for r in corpus_terms(i).orderBy("df", "term").collect()]
    return M.search_expression(i, " OR ".join(terms)).select("path", "title", "type", F.round("rank", 6).alias("rank"), "snippet")


def _sql_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(
    f"""SELECT conv_id, turn,
  list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[''‘’]s([^a-z0-9_]|$)', '\\1', 'g'), '[^a-z0-9_ \\t\\n]', ' ', 'g'), '[ \\t\\n]+'), lambda t: length(t) >= 2 AND t NOT IN {_sql_list(S.ANALYSIS_STOP_WORDS)}) AS analysis,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(text), '[-"*()^?!]', ' ', 'g'), '[ \\t\\n]+'), lambda t: regexp_replace(t, '[^a-z0-9_]', '', 'g')), lambda t: length(t) >= 2 AND t NOT IN {_sql_list(S.SEARCH_STOP_WORDS)}) AS search
FROM conversations WHERE role = 'user'""", lists=("analysis", "search",)
)
def tokenize_question(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", S.analysis_tokens("text").alias("analysis"), S.search_tokens("text").alias("search"))


_TYPES = " ".join(f"WHEN regexp_matches(q, '(^|[^A-Za-z0-9_])({w})([^A-Za-z0-9_]|$)') THEN '{n}'" for n, w in S.QUESTION_RULES)
_LEAD = "CASE turn % 5 WHEN 0 THEN 'What is the difference: ' WHEN 1 THEN 'Explain as well as ' WHEN 2 THEN 'Who, furthermore, ' WHEN 3 THEN 'why additionallyx ' ELSE '' END"


@query(
    f"""SELECT conv_id, turn, CASE {_TYPES} ELSE 'open-ended' END AS kind, regexp_matches(q, '\\b({S.COMPLEX_PHRASES})\\b') AS complex
FROM (SELECT conv_id, turn, lower({_LEAD} || text) AS q FROM conversations)"""
)
def question_classify(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn") % 5
    lead = F.when(t == 0, "What is the difference: ").when(t == 1, "Explain as well as ").when(t == 2, "Who, furthermore, ").when(t == 3, "why additionallyx ").otherwise("")
    q = F.concat(lead, F.col("text"))
    return V.table(spark, d, "conversations").select("conv_id", "turn", S.question_type(q).alias("kind"), S.is_complex(q).alias("complex"))
