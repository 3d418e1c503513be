"""Phrases, expressions and snippets against another engine's full-text index."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tomelight.operators import match, search

COLUMNS = ("title", "tags", "body")
WORDS = "run running runner cat cats über café cafe society societies model models the of data".split()


def docs():
    rng = random.Random(5)
    out = []
    for k in range(90):
        text = ""
        for _ in range(rng.choice([0, 3, 20, 34, 60, 200])):
            text += rng.choice(WORDS[: rng.choice([4, 8, 15])]) + rng.choice([" ", " ", " ", ". ", ": ", ", ", "\n", ".", "-", " \t"])
        out.append((f"p{k:03}", " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 5]))), rng.choice(["alpha", "beta gamma", "cat data", ""]), text))
    return out


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rows = docs()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, title, tags, body, tokenize='porter unicode61 remove_diacritics 2')")
    db.executemany("insert into t values (?,?,?,?)", rows)
    path = str(tmp_path_factory.mktemp("index") / "i")
    search.write_index(spark.createDataFrame(rows, "path string, title string, tags string, body string").repartition(3), path, stem=True)
    return db, search.read_index(spark, path)


EXPRESSIONS = [
    "cat", "running cat", '"cat data"', '"run cat" OR "data model"', "cat AND data NOT society", "cat NOT data NOT model", "caf*", '"the da"*', "^cat", "title : cat", "{title tags} : data", "- body : data", "NEAR(cat model)", 'NEAR("cat data" model, 2)',
    "NEAR(run cat über, 1)", "(cat OR data) AND (model OR society)", "cat OR data AND society", "über + cat", "body : (cat NOT über)", "title : ^run", "soc* mod*", '"run" cat', "tags : beta OR title : café", "NEAR(cat cat, 3)", "absent", '"cat cat"', '"cat cat" NOT absent', 'tags : "beta gamma"', "cat OR cats", '"..." OR cat',
]


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_expressions_find_the_same_pages(both, expression):
    db, index = both
    want = [p for (p,) in db.execute("select path from t where t match ? order by path", (expression,))]
    assert sorted(r["path"] for r in match.match_pages(index, expression).select("path").collect()) == want


@pytest.mark.parametrize("expression", ["cat", '"cat data"', "running cat", "caf* OR model", 'title : cat OR "data model"', "cat NOT data", "(über OR society) AND model"])
def test_ranks_and_snippets_are_the_same(both, expression):
    db, index = both
    want = db.execute("select path, round(bm25(t), 6), snippet(t, 3, '<b>', '</b>', '...', 32) from t where t match ? order by round(bm25(t), 9), path limit 40", (expression,)).fetchall()
    got = match.search_expression(index, expression, 40).orderBy(F.round("rank", 9), "path").collect()
    assert [(r["path"], round(r["rank"], 6)) for r in got] == [w[:2] for w in want]
    assert [r["snippet"] for r in got] == [w[2] for w in want]


@pytest.mark.parametrize("bad", ["cat AND", "(cat", "cat)", '"open', "nocolumn : cat", "NEAR(cat data, x)", "cat OR OR data", "{title : cat", "- cat", "*", "a % b"])
def test_unreadable_expressions(both, bad):
    db, index = both
    with pytest.raises(sqlite3.OperationalError):
        db.execute("select path from t where t match ?", (bad,)).fetchall()
    with pytest.raises(ValueError):
        match.match_pages(index, bad)


def test_nothing_to_look_for(both):
    for empty in ("", "  ", '""', '"..."'):
        assert match.match_pages(both[1], empty).collect() == []
    assert match.search_expression(both[1], "absent").collect() == []


def test_many_phrases_at_once(spark, tmp_path):
    rows = docs()
    search.write_index(spark.createDataFrame(rows, "path string, title string, tags string, body string"), str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    phrases = [(k, [rng.choice(WORDS[:8]) for _ in range(n)]) for k, (n, rng) in enumerate([(1 + j % 3, random.Random(j)) for j in range(40)])]
    phrases = [(k, [t for t in p if t.isascii()]) for k, p in phrases] + [(100, ["cat", "cat"]), (101, ["absent", "cat"])]
    want = []
    for k, p in phrases:
        for path, *columns in rows:
            n = sum(words[a : a + len(p)] == p for words in map(search.terms_of, columns) for a in range(len(words) - len(p) + 1)) if p else 0
            if n:
                want.append((k, path, n))
    got = match.phrase_hits(index, spark.createDataFrame(phrases, "id long, terms array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "body" not in got._jdf.queryExecution().executedPlan().toString()


def test_places_come_back_from_their_differences(spark):
    lists = [[5], [], [0, 1, 2], [7, 1 << 41, 3]]
    got = spark.createDataFrame([(x,) for x in lists], "g array<bigint>").coalesce(1).select(search.placed("g").alias("p")).collect()
    assert [r["p"] for r in got] == [[5], [], [0, 1, 3], [7, 7 + (1 << 41), 10 + (1 << 41)]]


def test_index_is_written_by_small_tasks(spark, tmp_path, monkeypatch):
    """Files are as many as the text needs, about even, and buckets and files both grow; what is found is the same."""
    rows = [(f"p{k}", f"head {k % 7}", "en", " ".join(f"w{(k * j) % 97}" for j in range(60)) + " the") for k in range(300)]
    pages = spark.createDataFrame(rows, "path string, title string, tags string, body string")
    monkeypatch.setattr(search, "FILE_BYTES", 1000.0, raising=False)
    search.write_index(pages, str(tmp_path / "i"))
    files = sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "i/postings")).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect())
    assert len(files) > 40 and files[-1] < 8 * sum(files) / len(files)
    index = search.read_index(spark, str(tmp_path / "i"))
    assert 5 <= index.buckets <= 12
    query = spark.createDataFrame([("the",), ("w13",), ("w40",)], "term string")
    shown = lambda found: [(r["path"], round(r["rank"], 9), r["matched"]) for r in found.collect()]
    assert shown(search.search(pages, query, 20, False, index=index)) == shown(search.search(pages, query, 20, False))


def test_many_phrases_read_places_on_few_pages(spark, tmp_path):
    """Phrases of frequent terms and a rare one: hits as counted by hand, and only pages with the rare term reach the gathering."""
    rows = [(f"p{k}", "the of", "en", " ".join(["the of and the"] * 5) + (f" rare the of the of{' x' * k} rare the" if k % 10 == 0 else "")) for k in range(200)]
    search.write_index(spark.createDataFrame(rows, "path string, title string, tags string, body string"), str(tmp_path / "i"))
    phrases = spark.createDataFrame([(1, ["rare", "the", "of", "the", "of"]), (2, ["the", "of", "and", "nowhere"]), (3, ["the", "of"]), (4, ["rare", "the"])], "id int, terms array<string>")
    found = match.phrase_hits(search.read_index(spark, str(tmp_path / "i")), phrases)
    got = {(r["id"], r["path"]): r["hits"] for r in found.collect()}
    rare = [f"p{k}" for k in range(0, 200, 10)]
    want = {(1, p): 1 for p in rare} | {(4, p): 2 for p in rare} | {(3, f"p{k}"): 6 + 2 * (k % 10 == 0) for k in range(200)}
    assert got == want
    tree = match.phrase_hits(search.read_index(spark, str(tmp_path / "i")), phrases.filter("id = 1"))._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("min_by(") == 1  # pages come from the rarest term
