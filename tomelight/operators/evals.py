"""Scoring retrieval, grounding, citations and judged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import search as S

GROUNDED, PASS_SCORE = 0.5, 0.8


def search_many(pages: DataFrame, queries: DataFrame, k: int, key: str = "path", columns: tuple[str, ...] = S.COLUMNS, index: S.Index | None = None) -> DataFrame:
    """spec_id, key, rank, nth: the top ``k`` pages with any term of each of many queries (spec_id, term)."""
    if index is not None:
        own = S.of_terms(index.postings, queries, index.buckets).select(key, "term", "tf", "doc_len")
        weighted = S.weights(own, S.of_terms(index.terms, queries, index.buckets).select("term", "df"), index.totals, key)
    else:
        lengths = pages.select(key, S.tokens(F.concat_ws(" ", *columns)).alias("terms")).select(key, F.size("terms").alias("doc_len"), "terms")
        totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len"))
        hits = lengths.select(key, "doc_len", F.explode("terms").alias("term")).join(queries.select("term").distinct(), "term")
        tf = hits.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
        weighted = S.weights(tf, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals, key)
    ranked = queries.join(weighted, "term").groupBy("spec_id", key).agg((-F.sum("w")).alias("rank"))
    nth = F.row_number().over(W.partitionBy("spec_id").orderBy(F.round("rank", 9), key))
    return ranked.withColumn("nth", nth).filter(F.col("nth") <= k)


def retrieval_scores(found: DataFrame, expected: DataFrame, k: int, threshold: float = 1.0, key: str = "path") -> DataFrame:
    """spec_id, recall, precision, score, passed of top-k hits against expected pages."""
    hits = found.groupBy("spec_id").agg(F.count(F.lit(1)).alias("hits"))
    good = found.join(expected, ["spec_id", key], "left_semi").groupBy("spec_id").agg(F.count(F.lit(1)).alias("good"))
    want = expected.distinct().groupBy("spec_id").agg(F.count(F.lit(1)).alias("wanted"))
    j = want.join(hits, "spec_id", "left").join(good, "spec_id", "left").na.fill(0, ["hits", "good"])
    recall = F.col("good") / F.col("wanted")
    precision = F.when(F.col("hits") > 0, F.col("good") / F.least(F.lit(k), F.col("hits"))).otherwise(0.0)
    scored = j.select("spec_id", recall.alias("recall"), precision.alias("precision"), ((recall + precision) / 2).alias("score"))
    return scored.withColumn("passed", F.col("score") >= threshold)


def grounding_scores(found: DataFrame, texts: DataFrame, phrases: DataFrame, key: str = "path") -> DataFrame:
    """spec_id, grounding: share of expected phrases that the retrieved pages contain, ignoring case."""
    near = phrases.join(found.select("spec_id", key), "spec_id", "left").join(texts, key, "left")
    hit = F.coalesce(F.lower("text").contains(F.lower("phrase")), F.lit(False))
    per = near.groupBy("spec_id", "phrase").agg(F.max(hit).alias("hit"))
    return per.groupBy("spec_id").agg(F.avg(F.col("hit").cast("int")).alias("grounding"))


def resolve_citations(pages: DataFrame) -> DataFrame:
    """path, kind, ref, target of each citation and link; on equal keys the last page wins, '' if none does."""
    titles = pages.groupBy(F.lower(F.trim("title")).alias("k")).agg(F.max_by("path", "ord").alias("target"))
    slugs = pages.groupBy(F.lower("slug").alias("k")).agg(F.max_by("path", "ord").alias("target"))
    cites = pages.select("path", F.lit("source").alias("kind"), F.explode(T.source_citations("body")).alias("ref"))
    links = pages.select("path", F.lit("link").alias("kind"), F.explode(T.wikilinks("body")).alias("ref")).withColumn("ref", F.trim(F.substring_index("ref", "|", 1))).filter("ref <> ''")
    resolve = lambda rows, index: rows.withColumn("k", F.lower("ref")).join(index, "k", "left").select("path", "kind", "ref", F.coalesce("target", F.lit("")).alias("target"))
    return resolve(cites, titles).unionByName(resolve(links, slugs))


def citation_scores(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("target") != "").alias("verified"), F.avg((F.col("target") != "").cast("int")).alias("score"))


_CLAIMS = "struct<claims: array<struct<claim: string, supported: boolean>>>"


def faithfulness(pages: DataFrame) -> DataFrame:
    """id, supported, total, score for ``pages`` (id, response); null scores where the response has no claim list."""
    parsed = pages.select("id", F.from_json(T.llm_json("response"), _CLAIMS).alias("j")).select("id", F.col("j.claims").alias("c"))
    usable = F.col("c").isNotNull() & ~F.exists("c", lambda x: x["supported"].isNull())
    good = F.size(F.filter("c", lambda x: x["supported"])).cast("bigint")
    total = F.size("c").cast("bigint")
    return parsed.select("id", F.when(usable, good).alias("supported"), F.when(usable, total).alias("total"), F.when(usable, F.when(total == 0, 1.0).otherwise(good / total)).alias("score"))


def rubric(rows: DataFrame, criteria: list[str]) -> DataFrame:
    """id, score for ``rows`` (id, scores: array of criterion and score): mean over five, null unless each criterion is there once from 1 to 5."""
    names = F.transform("scores", lambda s: s["criterion"])
    ok = (F.sort_array(names) == F.array(*(F.lit(c) for c in sorted(criteria)))) & ~F.exists("scores", lambda s: (s["score"] < 1) | (s["score"] > 5))
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s["score"])
    return rows.select("id", F.when(ok, F.round(total / len(criteria) / 5, 4)).alias("score"))


def eval_totals(results: DataFrame) -> DataFrame:
    """type, total, passed, failed; a result without a score is a crashed one, failed with 0."""
    score = F.coalesce("score", F.lit(0.0))
    ok = score >= F.col("threshold")
    return results.groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.avg(score).alias("mean_score"))


def verdicts(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per citation: UNVERIFIED without a readable source or any phrase in it, else VERIFIED with the share found; CHALLENGED without a citation."""
    s = sources.select(F.col("path").alias("cited"), F.col("text").alias("source_text"))
    j = answers.join(s, "cited", "left")
    found = F.size(F.filter("phrases", lambda p: F.lower(F.col("source_text")).contains(F.lower(p))))
    share = F.when(F.size("phrases") > 0, found / F.size("phrases")).otherwise(0.0)
    verdict = F.when(F.col("cited").isNull(), "CHALLENGED").when(F.col("source_text").isNull() | (share == 0), "UNVERIFIED").otherwise("VERIFIED")
    return j.select("id", verdict.alias("verdict"), F.when(verdict == "VERIFIED", share).otherwise(0.0).alias("score"))


def scorecard(judged: DataFrame) -> DataFrame:
    """intent, verified, challenged, unverified, verify_rate, robust (all paraphrases verified)."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return judged.groupBy("intent").agg(count("VERIFIED").alias("verified"), count("CHALLENGED").alias("challenged"), count("UNVERIFIED").alias("unverified"), (count("VERIFIED") / F.count(F.lit(1))).alias("verify_rate"), F.bool_and(F.col("verdict") == "VERIFIED").alias("robust"))


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9-]{2,}"), F.lit(0)), lambda w: ~w.isin(*S.SEARCH_STOP_WORDS)))


def overlap(title: Column, text: Column) -> Column:
    """Share of the title's content words that the text has; 1 without any."""
    words = content_words(title)
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, content_words(text))) / F.size(words))


def substring_grade(phrases: Column, text: Column) -> Column:
    hits = F.size(F.filter(phrases, lambda p: F.lower(text).contains(F.lower(p))))
    return F.when(hits == F.size(phrases), "PASS").when(hits > 0, "PARTIAL").otherwise("FAIL")


def floor_gate(scores: DataFrame, floors: DataFrame, target: float = PASS_SCORE) -> DataFrame:
    """name, status of scores against committed floors; without a floor the score is only recorded."""
    j = scores.join(floors, "name", "left")
    return j.select("name", F.when(F.col("floor").isNull(), "recorded").when(F.col("score") < F.col("floor"), "regression").when(F.col("score") < target, "warning").otherwise("pass").alias("status"))
