"""Records, specs and composed files on hand-made rows; stemming against SQLite's index."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tomelight.functions import text as T
from tomelight.functions.stem import porter
from tomelight.operators import filters, merge, records, search
from tomelight.sources import readers


def one(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_mounts(spark):
    new = spark.createDataFrame([("a", "/a", True, 1), ("a", "/b", True, 2), ("b", "/c", False, 3), ("b", "/d", True, 4), ("old", "/e", True, 5)], "name string, path string, exists boolean, ord long")
    have = spark.createDataFrame([("m1", "old")], "id string, name string")
    assert one(records.register_mounts(new, have), "path", "outcome") == [("/a", "registered"), ("/b", "duplicate"), ("/c", "missing"), ("/d", "registered"), ("/e", "duplicate")]
    assert records.remove_mounts(have, spark.createDataFrame([("m1",), ("zz",)], "id string")).count() == 0


def test_supported_files_and_scan(spark, tmp_path):
    for name in ("a.md", "b.png", ".hidden.md", "sub/c.HTML", "node_modules/d.md", "sub/.x/e.txt", "sub/f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * 5)
    got = readers.scan_directory(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["type"], r["n_bytes"]) for r in got.collect()) == [("a.md", "markdown", 5), ("c.HTML", "html", 5), ("f.txt", "text", 5)]


def test_wiki_folders(spark, tmp_path):
    for name in ("topics/a.md", "concepts/b.md", "drafts/c.md", "index.md"):
        (tmp_path / "wiki" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "wiki" / name).write_text("# x")
    assert one(readers.read_wiki(spark, str(tmp_path)), "dir", "slug") == [("concepts", "b"), ("topics", "a")]


def test_changed_files(spark):
    lists = spark.createDataFrame([(1, " a.md,b.md\n\na.md , c.md"), (2, "")], "list_id long, arg string")
    latest = spark.createDataFrame([("a.md", "h")], "path string, hash string")
    assert one(records.changed_files(lists, latest), "list_id", "n", "path", "hash") == [(1, 0, "a.md", "h"), (1, 1, "b.md", ""), (1, 2, "c.md", "")]


def test_provenance_is_appended_by_source(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "wiki/a.md", "topic", "compile", "2024"), ("s2", "wiki/a.md", "topic", "compile", "2024")], "source_id string, output_path string, output_type string, operation string, recorded_at string")
    for _ in range(2):
        records.write_provenance(rows, str(tmp_path / "p"))
    lines = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "p")).filter("source_id = 's1'").collect()]
    assert len(lines) == 2 and lines[0] == lines[1] and list(lines[0]) == ["id", "sourceId", "outputPath", "outputType", "operation", "recordedAt"]


def test_anchor_lines_keep_their_place(spark):
    lines = spark.createDataFrame([(1, '{"totalEvents":3,"chainHead":"h","prevAnchorHash":null,"anchorHash":"a"}'), (2, "{broken"), (3, " "), (4, '{"totalEvents":4}{')], "ord long, line string")
    assert one(records.read_anchors(lines).fillna("-").fillna(-1), "ord", "total", "head", "malformed") == [(1, 3, "h", False), (2, -1, "-", True), (4, -1, "-", True)]


def test_tokens_are_summed_and_rounded(spark):
    have = spark.createDataFrame([("a", 5), ("b", None), ("c", 7)], "id string, judge_tokens long")
    uses = spark.createDataFrame([("a", 1.5), ("a", 2.4), ("b", float("nan")), ("b", 3.0), ("zz", 1.0), ("c", float("inf"))], "id string, tokens double")
    assert one(records.record_tokens(have, uses).fillna("-").fillna(-1), "id", "judge_tokens", "error") == [("a", 9, "-"), ("b", 3, "BAD_NUMBER"), ("c", 7, "BAD_NUMBER"), ("zz", -1, "UNKNOWN_ID")]


def test_promotion_and_its_undoing(spark):
    rows = spark.createDataFrame([("outputs/r.md", "My Page!", "topic", None, "t"), ("outputs/x.md", "??", "reference", None, "t"), ("outputs/y.md", "No", "topic", "EMPTY_FILE", "t")], "path string, title string, type string, code string, at string")
    done = records.promote(rows)
    assert one(done, "source_path", "target_path") == [("outputs/r.md", "wiki/topics/my-page.md"), ("outputs/x.md", "wiki/sources/item.md")]
    gone = records.unpromote(done, spark.createDataFrame([("wiki/topics/my-page.md",), ("wiki/z.md",)], "path string"))
    assert one(gone, "path", "outcome") == [("wiki/topics/my-page.md", "removed"), ("wiki/z.md", "NOT_PROMOTED")]


def test_tasks_move_only_as_allowed(spark):
    tasks = spark.createDataFrame([("a", "rendering"), ("b", "created"), ("c", "completed")], "id string, status string")
    moves = spark.createDataFrame([("a", "completed", "t1"), ("b", "archived", "t2"), ("c", "archived", "t3"), ("x", "created", "t4")], "id string, to string, at string")
    got = {r["id"]: (r["status"], r["outcome"], r["completed_at"], r["archived_at"]) for r in records.move_tasks(tasks, moves).collect()}
    assert got == {"a": ("completed", "moved", "t1", None), "b": ("created", "INVALID_TRANSITION", None, None), "c": ("archived", "moved", None, "t3"), "x": (None, "NOT_FOUND", None, None)}


def test_bundle_numbers_are_written_as_in_javascript(spark):
    import hashlib

    rows = spark.createDataFrame([("a b", "smoke", True, 1.0, 0.5)], "id string, type string, passed boolean, score double, threshold double")
    row = records.bundle_subjects(rows, "x:local:").first()
    assert row["name"] == "x:local:a-b"
    assert row["sha256"] == hashlib.sha256(b'{"id":"a b","passed":true,"score":1,"threshold":0.5,"type":"smoke"}').hexdigest()
    assert json.loads(records.bundle_lines(records.bundle_subjects(rows)).first()["line"])["name"] == "eval:local:a-b"


def test_specs_load_each_for_itself(spark):
    good = {"id": "r", "name": "n", "type": "retrieval", "question": "q", "expected_pages": ["p"], "threshold": 0.5}
    cases = {"good": good, "id": good | {"id": " "}, "type": good | {"type": "x"}, "unit": good | {"threshold": 2}, "pages": good | {"expected_pages": []}, "k": good | {"k": 0}, "smoke": {"id": "s", "name": "n", "type": "smoke"}}
    files = [(n, json.dumps(c)) for n, c in cases.items()] + [("list", "[1]"), ("broken", "{")]
    got = {r["path"]: r["error"] for r in records.load_specs(spark.createDataFrame(files, "path string, raw string")).collect()}
    assert got == {"good": None, "id": "id: empty", "type": "type: unknown", "unit": "threshold: not in [0, 1]", "pages": "expected_pages: empty", "k": "k: not positive", "smoke": None, "list": "not an object", "broken": "not readable: line 1: } is missing"}


def test_bank_modes(spark):
    schema = "intent_id string, question string, paraphrases array<struct<text string, primary boolean>>"
    bank = spark.createDataFrame([("a", "one?", None), ("b", None, [("x", False), ("y", True)]), ("c", None, []), ("d", "q", [("z", True)])], schema)
    assert one(records.bank_prompts(bank.filter("intent_id < 'c'"), "primary"), "intent_id", "text") == [("a", "one?"), ("b", "y")]
    assert records.bank_prompts(bank.filter("intent_id < 'c'")).count() == 3
    assert one(records.bank_errors(bank).fillna("-"), "intent_id", "error") == [("a", "-"), ("b", "-"), ("c", "no question"), ("d", "two shapes")]
    with pytest.raises(ValueError):
        records.bank_prompts(bank, "some")


def test_field_kinds(spark):
    uid = "01234567-89ab-cdef-0123-456789abcdef"
    whole = {"id": uid, "title": "T", "entity_type": "tool", "source_ids": f"[{uid}, {uid}]", "compiled_at": "2024-01-01T00:00:00Z", "model": "m"}
    cases = {"ok": whole, "url": whole | {"url": "nowhere"}, "ids": whole | {"source_ids": "[x]"}, "text": whole | {"title": "2024"}, "kind": whole | {"entity_type": "thing"}, "time": whole | {"compiled_at": "2024"}, "lack": {k: v for k, v in whole.items() if k != "model"}}
    df = spark.createDataFrame([(n, c) for n, c in cases.items()], "n string, f map<string,string>").select("n", filters.schema_errors(F.lit("entity"), F.col("f")).alias("e"))
    assert {r["n"]: r["e"] for r in df.collect()} == {"ok": [], "url": ["url: invalid url"], "ids": ["source_ids: invalid uuids"], "text": ["title: invalid text"], "kind": ["entity_type: invalid entity"], "time": ["compiled_at: invalid time"], "lack": ["model: required"]}


def test_html_to_markdown(spark):
    html = '<html><body class="x"><h1>Main <i>Heading</i></h1><p>A <strong>bold</strong> <a href="http://x/?a=1&amp;b">link</a>.</p><ul><li>one</li><li>two</li></ul><pre><code class="js">const x = 1;\nlet y;</code></pre><script>no()</script><p>1 &lt; 2</p></body></html>'
    got = spark.createDataFrame([(html,)], "html string").select(T.html_markdown(T.html_body("html")).alias("m")).first()["m"]
    assert got == "# Main _Heading_\n\nA **bold** [link](http://x/?a=1&b).\n\n*   one\n*   two\n\n```\nconst x = 1;\nlet y;\n```\n\n1 < 2"


def test_sources_are_read_by_type(spark):
    files = spark.createDataFrame([("a.md", "---\ntitle: One\n---\ntwo words"), ("b.html", "<title>Two</title><body><p>three words here</p></body>"), ("c.txt", "# Head\nx"), ("d.pdf", "%PDF")], "path string, raw string")
    assert one(readers.ingest_sources(files), "path", "type", "title", "words") == [("a.md", "markdown", "One", 2), ("b.html", "html", "Two", 3), ("c.txt", "text", "Head", 3)]


def test_quiz_file_reads_back(spark):
    from tomelight.operators.exports import parse_quiz

    item = "array<struct<question string, answer string, sources array<string>>>"
    quiz = spark.createDataFrame([(1, "Topic", "now", "m", 1, 2, ["p"], [("Q one?", "A one", ["raw/x.md"]), ("Q two?", "A two", [])])], f"id int, topic string, generated_at string, model string, input_tokens long, output_tokens long, source_pages array<string>, items {item}")
    back = parse_quiz(quiz.select("id", "topic", records.compose_quiz(quiz).alias("quiz")), "id")
    assert one(back, "n", "question", "concept") == [(1, "Q one?", "x"), (2, "Q two?", "Topic")]


def test_quiz_of_many_questions_is_whole(spark):
    from tomelight.operators.exports import parse_quiz

    text = "".join(f"## Question {k}\nq{k}\n<details>a</details>\n" for k in range(1500))
    assert parse_quiz(spark.createDataFrame([(1, "t", text)], "id int, topic string, quiz string"), "id").count() == 1500


def test_folded_events_equal_a_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(k % 3 if k % 2 else 7, k, rng.randrange(5000)) for k in range(400)]
    got = {r["event_id"]: r["accepted"] for r in merge.debounce(spark.createDataFrame(rows, "user_id long, event_id long, ms long"), 300).collect()}
    last: dict[int, int] = {}
    for user, event, ms in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        ok = user not in last or ms - last[user] >= 300
        last[user] = ms if ok else last[user]
        assert got[event] == ok


def test_numbers_in_hot_groups(spark):
    from tomelight.operators.numbering import numbered

    rows = [("hot" if k % 7 else None if k % 2 else f"g{k % 5}", (k * 37) % 3000, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, at long, k long").repartition(9)
    want: dict = {}
    for g, at, k in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, []).append(k)
    got = numbered(df, "g", ["at"])
    assert got.columns == ["g", "at", "k", "nth"]
    assert {(r["g"], r["k"]): r["nth"] for r in got.collect()} == {(g, k): n for g, ks in want.items() for n, k in enumerate(ks, 1)}
    assert numbered(df.limit(0), "g", ["at"]).count() == 0


# --- stemming -----------------------------------------------------------------------------------

WORDS = (
    "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer "
    "conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical "
    "hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate "
    "cease controll roll running runner runs easily fairly generalizations oscillators university universal news skies dying"
).split()


def sqlite_stem(words):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(w, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, w) values (?, ?)", list(enumerate(words)))
    return {doc: term for term, doc in db.execute("select term, doc from v")}


def test_porter_equals_sqlite():
    want = sqlite_stem(WORDS)
    assert {w: porter(w) for w in WORDS} == {w: want[k] for k, w in enumerate(WORDS)}


def test_stored_stemmed_index_equals_sqlite(spark, tmp_path):
    docs = [("a", "Running shoes", "x", "He was running and runs daily, café"), ("b", "other", "y", "a runner ran; Cafe societies"), ("c", "third", "z", "Über cats and a cat"), ("d", "fourth", "w", "nothing here uber society"), *((f"e{k}", "fill", "w", f"filler words {k}") for k in range(8))]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, title, tags, body, tokenize='porter unicode61 remove_diacritics 2')")
    db.executemany("insert into t values (?,?,?,?)", docs)
    pages = spark.createDataFrame(docs, "path string, title string, tags string, body string")
    search.write_index(pages, str(tmp_path / "i"), stem=True)
    index = search.read_index(spark, str(tmp_path / "i"))
    for match, terms in (("running", ["running"]), ("cafe", ["Café"]), ("uber OR cats", ["über", "cats"]), ("society", ["society"])):
        want = {p: round(r, 6) for p, r in db.execute("select path, bm25(t) from t where t match ?", (match,))}
        query = spark.createDataFrame([(x,) for x in terms], "term string")
        assert want and {r["path"]: round(r["rank"], 6) for r in search.search(pages, query, 20, match_all=False, index=index).collect()} == want


def test_stored_index_equals_the_pages(spark, tmp_path):
    docs = [(f"p{k}", "title", "tag", " ".join(f"w{(k * j) % 17}" for j in range(1, 40))) for k in range(60)]
    pages = spark.createDataFrame(docs, "path string, title string, tags string, body string")
    search.write_index(pages, str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    query = spark.createDataFrame([("w3",), ("w16",), ("absent",)], "term string")
    direct = {r["path"]: (round(r["rank"], 9), r["matched"]) for r in search.bm25(pages, query).collect()}
    assert direct and direct == {r["path"]: (round(r["rank"], 9), r["matched"]) for r in search.bm25(pages, query, index=index).collect()}
    scans = [x for x in search.bm25(pages, query, index=index)._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "term" in x]
    assert scans and all("In(term, [" in x and "bucket" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)  # only the terms' buckets are read


def test_usage_line_rounds_as_sql(spark):
    """Halves of a cent, exact in binary or not, as C's printf rounds them."""
    import duckdb

    prices = [(15_000, 80_000), (31_600, 200), (5_000, 0), (15_000, 0), (25_000, 0), (335_000, 0), (1_005_000, 0), (400_000_000, 1)]
    rows = spark.createDataFrame([(k, i, o, "claude-sonnet-4-6") for k, (i, o) in enumerate(prices)], "k int, i long, o long, m string")
    got = [r["line"] for r in rows.select("k", records.usage_line(F.col("i"), F.col("o"), F.col("m")).alias("line")).orderBy("k").collect()]
    want = [duckdb.sql(f"SELECT 'Used ' || format('{{:,}}', {i + o}) || ' tokens (~$' || printf('%.2f', ({i} * 3.0::DOUBLE + {o} * 15.0::DOUBLE) / 1000000) || ')'").fetchall()[0][0] for i, o in prices]
    assert got == want


def test_spool_file_comes_in_slices(spark, monkeypatch):
    """Files of several slices and ranges have the hash of their lines in order; the last task gets them compressed."""
    import hashlib

    monkeypatch.setattr(records, "SLICE_BYTES", 500, raising=False)
    rows = [("ab"[k % 3 == 0], f"p{k:04d}", f'{{"n":{k},"é":"{"word " * (k % 9)}"}}') for k in range(400)]
    out = records.spool_manifest(spark.createDataFrame(rows[::-1], "category string, path string, line string").repartition(5))
    want = []
    for c in "ab":
        data = "".join(line + "\n" for category, _, line in rows if category == c).encode()
        want.append((c, sum(r[0] == c for r in rows), len(data), hashlib.sha256(data).hexdigest()))
    assert sorted(map(tuple, out.collect())) == want
    assert "rangepartitioning" in out._jdf.queryExecution().executedPlan().toString()
    empty = records.spool_manifest(spark.createDataFrame([], "category string, path string, line string"))
    assert empty.collect() == []
