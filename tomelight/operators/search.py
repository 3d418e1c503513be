"""Full-text search: postings, BM25, strict and broad matching, re-ranking.

A page's terms come from its indexed columns together.  A stored index holds the postings by bucket
of their term, with the places of the term as differences, so a question reads those of its own
terms, and document frequencies and the average length ready made; and the pages by bucket of their
key, so what was found is shown without reading other pages.  Without an index, postings of the
question's terms are filtered from the pages before anything is shuffled.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import porter
from ..session import fill_cores

K1, B = 1.2, 0.75
#: Smallest inverse document frequency: terms in half the pages or more still order matches.
LEAST_IDF = 1e-6
FETCH_MULTIPLIER = 3
TITLE_BOOST, TYPE_BOOST = 0.5, 0.3
#: Text bytes whose postings one task sorts, in memory, and writes as a file of a stored index.
FILE_BYTES = 12e6
#: Least files of a bucket of a stored index, and its most buckets.
LEAST_FILES, MOST_BUCKETS = 4, 1024
#: Bytes of the dictionary of a file's keys, which come again for every term.
KEYS_BYTES = 8 << 20
#: Terms up to which a question's buckets and terms are given to the scan as values.
MOST_TERMS = 500
COLUMNS = ("title", "tags", "body")
#: A term's place is its column's number times this, and the number of terms before it there.
COLUMN_PLACES = 1 << 40
#: Terms whose postings are made at once.
SLICE_TERMS = 500_000

# Words that a question's search terms leave out; the first list is the longer one of
# the question analysis, the second that of the page search.
ANALYSIS_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought used "
    "what which who whom whose when where why how that this these those it its in on at to for of and or but not with from by as if so yet both "
    "either neither whether about above across after against along among around before behind below beneath beside between beyond during into "
    "near off out over through under until up upon within without also me my you your we our they their i define explain describe tell please give show"
).split()
SEARCH_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can what which who whom whose "
    "when where why how that this these those it its in on at to for of and or but not with from by as if so me my you your we our they their "
    "i define explain describe tell please give show also about"
).split()
QUESTION_RULES = (
    ("comparative", "compare|vs|difference|differences|versus"),
    ("analytical", "why|how does|explain|analyze|analyse"),
    ("factual", "what is|what are|define|definition|when|where|who"),
)
COMPLEX_PHRASES = "and also|additionally|furthermore|moreover|as well as"
PREFERRED_TYPES = {"analytical": ("topic", "concept"), "comparative": ("topic", "concept"), "factual": ("source-summary", "entity")}


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit("[a-z0-9]+"), F.lit(0))


def analysis_tokens(question: Column | str) -> Column:
    """Terms of the question analysis: possessives cut, punctuation to spaces, two characters and up."""
    q = F.regexp_replace(F.lower(F.col(question) if isinstance(question, str) else question), "['‘’]s([^a-z0-9_]|$)", "$1")
    parts = F.split(F.regexp_replace(q, "[^a-z0-9_ \\t\\n]", " "), "[ \\t\\n]+")
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*ANALYSIS_STOP_WORDS))


def search_tokens(question: Column | str) -> Column:
    """Terms of the page search: operators to spaces, other punctuation deleted inside words."""
    q = F.regexp_replace(F.lower(F.col(question) if isinstance(question, str) else question), '[-"*()^?!]', " ")
    parts = F.transform(F.split(q, "[ \\t\\n]+"), lambda t: F.regexp_replace(t, "[^a-z0-9_]", ""))
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*SEARCH_STOP_WORDS))


def question_type(question: Column) -> Column:
    from ..functions.text import bounded

    out = F.lit("open-ended")
    for name, words in reversed(QUESTION_RULES):
        out = F.when(F.lower(question).rlike(bounded(words)), name).otherwise(out)
    return out


def is_complex(question: Column) -> Column:
    from ..functions.text import bounded

    return F.lower(question).rlike(bounded(COMPLEX_PHRASES))


@lru_cache(maxsize=1)
def _marks() -> tuple[str, str]:
    """Letters that are a letter and marks, and those letters; by the character database."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, min(0x2000, sys.maxunicode)) if unicodedata.category(chr(c))[0] == "L" and unicodedata.combining((unicodedata.normalize("NFD", chr(c)) + "a")[1])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unicode_tokens(text: Column | str) -> Column:
    """Terms of letters and digits of any script, lower case and without diacritics."""
    folded = F.translate(F.lower(F.col(text) if isinstance(text, str) else text), *_marks())
    return F.regexp_extract_all(F.regexp_replace(folded, r"\p{M}+", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def terms_of(text: str, fold: bool = False, stem: bool = False) -> list[str]:
    """The terms of one text, as an index has them; for questions, which are short."""
    if not fold:
        return re.findall("[a-z0-9]+", text.lower())
    low = unicodedata.normalize("NFD", text.lower().translate(str.maketrans(*_marks())))
    plain = "".join(c for c in low if unicodedata.category(c)[0] != "M")
    found = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", plain))
    return [porter(t) for t in found] if stem else found


_stems = lru_cache(maxsize=1 << 18)(porter)


def stemmed(words: DataFrame) -> DataFrame:
    """term, stem of the distinct ``words.term``: only the vocabulary goes through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array([porter(t) for t in batch.column("term").to_pylist()], pa.string())], names=["term", "stem"])

    return words.select("term").distinct().mapInArrow(run, "term string, stem string")


def _posted(batch: pa.RecordBatch, stem: bool) -> pa.RecordBatch:
    """Postings of a batch of (key, terms of each column): key, term, tf, doc_len, gaps."""
    n, rows, places, terms = batch.num_rows, [], [], []
    for c, column in enumerate(batch.columns[1:]):
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows.append(np.repeat(np.arange(n), sizes))
        places.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + c * COLUMN_PLACES)
        terms.append(column.flatten())
    row, place = np.concatenate(rows), np.concatenate(places)
    coded = pa.chunked_array(terms).combine_chunks().dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy()
    if stem:  # each distinct term once
        again = pa.array([_stems(t) for t in vocabulary.to_pylist()], pa.string()).dictionary_encode()
        vocabulary, code = again.dictionary, again.indices.to_numpy()[code]
    order = np.lexsort((place, code, row))
    row, code, place = row[order], code[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    length = np.bincount(row, minlength=n)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(gaps, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row[first])), vocabulary.take(pa.array(code[first])), pa.array(np.diff(np.append(first, len(row))), pa.int64()), pa.array(length[row[first]], pa.int32()), lists],
        names=[batch.schema.names[0], "term", "tf", "doc_len", "gaps"],
    )


def postings(pages: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "path", fold: bool = False, stem: bool = False) -> DataFrame:
    """key, term, tf, doc_len, gaps for every term of every page.

    ``gaps`` are the term's places in ascending order, each as the difference to the one before.
    With ``fold`` terms are of any script and without diacritics, with ``stem`` they are stems.
    """
    split = unicode_tokens if fold else tokens
    rows = pages.select(key, *(split(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_{k}") for k, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
            slot = (np.cumsum(sizes) - 1) // SLICE_TERMS
            cuts = np.flatnonzero(np.diff(slot, prepend=-2)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                yield _posted(batch.slice(a, b - a), stem)

    return rows.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, term string, tf long, doc_len int, gaps array<long>")


def placed(gaps: Column | str) -> Column:
    """Places again from their differences."""

    def run(lists: pa.Array) -> pa.Array:
        flat = np.cumsum(lists.flatten().to_numpy(zero_copy_only=False))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        before = np.concatenate(([0], flat))[ends - sizes]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat - np.repeat(before, sizes), pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(gaps)


@dataclass(frozen=True)
class Index:
    """A stored index: postings (bucket, term, key, tf, doc_len, gaps), terms (bucket, term, df, total_tf), totals (n, avg_len), pages (bucket, key and its columns)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    buckets: int
    stem: bool = False
    pages: DataFrame | None = None
    columns: tuple[str, ...] = COLUMNS
    key: str = "path"


def _bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(pages: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, key: str = "path", stem: bool = False) -> None:
    """Store the index of ``pages`` below ``path``, one folder a bucket, terms or keys in order within files; the totals come last.

    With ``stem`` terms are folded and stemmed.
    """
    spark = pages.sparkSession
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.concat_ws(" ", *columns)).cast("long"))).first()
    # A bucket's rows are dealt over several files by key, so a term that every page has is not one task's.
    # Buckets and files both grow with the root of the input: a file has few keys, and each of them many times.
    tasks = math.ceil((size or 0) / FILE_BYTES)
    files = max(LEAST_FILES, math.isqrt(tasks))
    buckets = min(MOST_BUCKETS, max(1, math.ceil(tasks / files)))
    files = max(files, math.ceil(tasks / buckets), math.ceil(spark.sparkContext.defaultParallelism / buckets))

    def dealt(rows: DataFrame, term: Column, seed: int) -> DataFrame:
        at = _bucket(term, buckets) * files + F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(files)).cast("int")
        return rows.repartitionById(buckets * files, at).withColumn("bucket", _bucket(term, buckets))

    # What follows from a posting is not sent with it.
    sent = dealt(postings(fill_cores(pages), columns, key, stem, stem).drop("tf"), F.col("term"), 0)
    rows = sent.select("bucket", key, "term", F.size("gaps").cast("long").alias("tf"), "doc_len", "gaps")
    rows.sortWithinPartitions("bucket", "term").write.option("parquet.dictionary.page.size", KEYS_BYTES).partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    terms = stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    terms.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    dealt(pages, F.col(key).cast("string"), 1).sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/pages")
    total = spark.read.parquet(f"{path}/terms").agg(F.coalesce(F.sum("total_tf"), F.lit(0)).alias("tokens"))
    total.select(
        F.lit(n).cast("long").alias("n"), (F.col("tokens") / F.lit(max(n, 1))).alias("avg_len"), F.lit(buckets).alias("buckets"), F.lit(stem).alias("stem"), F.array(*map(F.lit, columns)).alias("columns"), F.lit(key).alias("key")
    ).write.parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str) -> Index:
    """The index that ``write_index`` stored below ``path``."""
    kept = spark.read.parquet(f"{path}/totals")
    how = kept.first()
    return Index(
        spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), kept.select("n", "avg_len"), how["buckets"], how["stem"], spark.read.parquet(f"{path}/pages"), tuple(how["columns"]), how["key"]
    )


def stored_pages(index: Index, found: DataFrame) -> DataFrame:
    """``found`` joined with the stored columns of its pages.

    The few keys of a limited result reach the scan as values; many are joined.
    """
    key, spark = index.key, found.sparkSession
    few = found.limit(MOST_TERMS + 1).collect()
    if len(few) > MOST_TERMS:
        return found.join(index.pages.drop("bucket"), key)
    local = spark.createDataFrame(few, found.schema)
    if not few:
        return local.join(index.pages.drop("bucket").limit(0), key)
    buckets = spark.createDataFrame([(str(r[key]),) for r in few], "k string").select(_bucket("k", index.buckets).alias("b")).distinct().collect()
    own = index.pages.filter(F.col("bucket").isin(*(r["b"] for r in buckets)) & F.col(key).isin(*(r[key] for r in few)))
    return own.drop("bucket").join(F.broadcast(local), key)


def of_terms(stored: DataFrame, query: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``stored`` for the terms of ``query``; a question's few terms reach the scan as values."""
    wanted = query.select("term").distinct()
    few = wanted.select("term", _bucket("term", buckets).alias("bucket")).limit(MOST_TERMS + 1).collect()
    if len(few) > MOST_TERMS:
        return stored.join(wanted.withColumn("bucket", _bucket("term", buckets)), ["bucket", "term"], "left_semi")
    return stored.filter(F.col("bucket").isin(*{r["bucket"] for r in few}) & F.col("term").isin(*(r["term"] for r in few))) if few else stored.filter(F.lit(False))


def question(query: DataFrame, index: Index) -> DataFrame:
    """``query`` with its terms as ``index`` has them."""
    if not index.stem:
        return query
    folded = query.select(F.explode(unicode_tokens("term")).alias("term"))
    return stemmed(folded).select(F.col("stem").alias("term")).distinct()


def index_summary(pages: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "path") -> DataFrame:
    """term, df, total_tf over all pages."""
    return postings(pages, columns, key).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


def weights(tf: DataFrame, df: DataFrame, totals: DataFrame, key: str = "path") -> DataFrame:
    """key, term, w: what each posting (key, term, tf, doc_len) adds to a page's score."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, LEAST_IDF).otherwise(idf) * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len"))))
    return tf.join(df, "term").crossJoin(F.broadcast(totals)).select(key, "term", weight.alias("w"))


def bm25(pages: DataFrame, query: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "path", index: Index | None = None) -> DataFrame:
    """key, rank, matched for each page with a term of ``query.term``; lower ranks are better.

    ``query`` has one row a term of the question.  With ``index`` the pages are not read.
    """
    if index is not None:
        own = of_terms(index.postings, query, index.buckets).select(key, "term", "tf", "doc_len")
        scored = weights(own, of_terms(index.terms, query, index.buckets).select("term", "df"), index.totals, key)
    else:
        lengths = pages.select(key, tokens(F.concat_ws(" ", *columns)).alias("terms")).select(key, "terms", F.size("terms").alias("doc_len"))
        totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len"))
        hits = lengths.select(key, "doc_len", F.explode("terms").alias("term")).join(query.select("term").distinct(), "term")
        tf = hits.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
        scored = weights(tf, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals, key)
    return scored.groupBy(key).agg((-F.sum("w")).alias("rank"), F.count(F.lit(1)).alias("matched"))


def search(pages: DataFrame, query: DataFrame, limit: int = 20, match_all: bool = True, columns: tuple[str, ...] = COLUMNS, key: str = "path", index: Index | None = None) -> DataFrame:
    """The best pages for the terms, ties by key; all terms must match, or any."""
    query = query if index is None else question(query, index)
    ranked = bm25(pages, query, columns, key, index)
    if match_all:
        wanted = query.agg(F.count_distinct("term").alias("wanted"))
        ranked = ranked.crossJoin(F.broadcast(wanted)).filter("matched = wanted").drop("wanted")
    return ranked.orderBy(F.round("rank", 9), key).limit(limit)


def strict_then_broad(pages: DataFrame, query: DataFrame, limit: int = 10, **kw) -> DataFrame:
    """Pages with all terms; if there are none, pages with any.  One pass over the postings."""
    query = question(query, kw["index"]) if kw.get("index") else query
    ranked = bm25(pages, query, **kw)
    key = ranked.columns[0]
    wanted = query.agg(F.count_distinct("term").alias("wanted"))
    flagged = ranked.crossJoin(F.broadcast(wanted)).withColumn("strict", F.col("matched") == F.col("wanted"))
    any_strict = flagged.agg(F.coalesce(F.max("strict"), F.lit(False)).alias("any_strict"))
    return flagged.crossJoin(F.broadcast(any_strict)).filter("strict OR NOT any_strict").orderBy(F.round("rank", 9), key).limit(limit).select(key, "rank", "matched", "strict")


def rerank(pages: DataFrame, query: DataFrame, kind: str, limit: int = 5, title: str = "title", key: str = "path", **kw) -> DataFrame:
    """The best ``limit`` of three times as many: a term in the title or a preferred type lowers the rank."""
    found = search(pages, query, limit * FETCH_MULTIPLIER, key=key, **kw)
    terms = query.agg(F.collect_set("term").alias("ts"))
    shown = stored_pages(kw["index"], found) if kw.get("index") else found.join(pages.select(key, title, "type"), key)
    paged = shown.crossJoin(F.broadcast(terms))
    in_title = F.exists("ts", lambda t: F.lower(F.col(title)).contains(t))
    preferred = PREFERRED_TYPES.get(kind, ())
    adjusted = F.col("rank") - F.when(in_title, TITLE_BOOST).otherwise(0.0) - (F.when(F.col("type").isin(*preferred), TYPE_BOOST).otherwise(0.0) if preferred else F.lit(0.0))
    return paged.select(key, "type", "rank", adjusted.alias("adjusted")).orderBy(F.round("adjusted", 9), F.round("rank", 9), key).limit(limit)


def ask_pages(pages: DataFrame, query: DataFrame, kind: str, limit: int = 5, **kw) -> DataFrame:
    """Re-ranked pages if there are any, else the first of the analysis."""
    boosted = rerank(pages, query, kind, limit, **kw).select("path", F.col("adjusted").alias("rank"), F.lit("boosted").alias("origin"))
    plain = strict_then_broad(pages, query, 10, **kw).orderBy(F.round("rank", 9), "path").limit(limit).select("path", "rank", F.lit("analysis").alias("origin"))
    has = boosted.agg((F.count(F.lit(1)) > 0).alias("has"))
    return boosted.unionByName(plain.crossJoin(F.broadcast(has)).filter("NOT has").drop("has"))


def evidence(pages: DataFrame, query: DataFrame, limit: int = 10, most: int = 4000, index: Index | None = None) -> DataFrame:
    """The best pages for any term with numbered file names and excerpts."""
    from pyspark.sql import Window as W

    from ..functions.text import excerpt

    found = search(pages, query, limit, match_all=False, index=index)
    # At most ``limit`` rows reach this window.
    n = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.round("rank", 9), "path"))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.md$", ""), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    ranked = found.withColumn("n", n)
    shown = stored_pages(index, ranked) if index is not None else ranked.join(pages.select("path", "body"), "path")
    return shown.select(
        "path", F.concat(F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("-"), slug, F.lit(".md")).alias("filename"), excerpt("body", most).alias("excerpt")
    )


def query_terms(df: DataFrame, terms: Column) -> DataFrame:
    return df.select(F.explode(terms).alias("term")).distinct()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
