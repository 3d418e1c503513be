"""Branches that the driver's tables do not reach, and properties of the aggregates."""

from __future__ import annotations

import hashlib
import json
import random
import re
import sqlite3
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomelight.functions import text as T
from tomelight.operators import audit, cost, evals, exports, filters, ingest, learn, lineage, merge, search
from tomelight.session import ship
from tomelight.sources import readers
from tomelight.streaming import traces

NO_FIXTURE = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(1)).select(column).first()[0]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- chains -------------------------------------------------------------------------------------


def chain(*days, legacy=()):
    rows, last = [], None
    for d, lines in enumerate(days):
        prev = None if d == 0 or d in legacy else last and sha(last)
        for n, raw in enumerate(lines, 1):
            rows.append((f"d{d}.jsonl", n, raw, prev, raw != "bad"))
            prev = sha(raw)
            if raw != "bad":
                last = raw
    return rows


LINES = "file string, line_no long, raw string, prev_hash string, parses boolean"


def verdict(spark, rows):
    return {r["file"]: (r["events"], r["breaks"], r["bad_line"], r["boundary"]) for r in audit.verify_chain(spark.createDataFrame(rows, LINES)).collect()}


def test_clean_chain(spark):
    assert verdict(spark, chain(["a", "b"], ["c"])) == {"d0.jsonl": (2, 0, None, "first"), "d1.jsonl": (1, 0, None, "linked")}


def test_tampered_line_counts_once_and_walk_goes_on(spark):
    rows = chain(["a", "b", "c", "d"])
    rows[1] = (*rows[1][:2], "B", *rows[1][3:])
    assert verdict(spark, rows)["d0.jsonl"] == (4, 1, None, "first")


def test_unreadable_line_ends_its_file_and_legacy_boundary_is_tolerated(spark):
    got = verdict(spark, chain(["a", "bad", "c"], ["d"], legacy=(1,)))
    assert got["d0.jsonl"] == (1, 0, 2, "first") and got["d1.jsonl"][3] == "legacy"


def test_missing_day_breaks_the_boundary(spark):
    rows = [r for r in chain(["a"], ["b"], ["c"]) if r[0] != "d1.jsonl"]
    assert verdict(spark, rows)["d2.jsonl"][3] == "broken"
    only_bad = [("d0.jsonl", 1, "bad", None, False)]
    assert verdict(spark, only_bad)["d0.jsonl"] == (0, 0, 1, "empty")


def test_built_chain_verifies(spark):
    events = spark.createDataFrame([("f", n, json.dumps({"k": n})) for n in range(1, 30)], "file string, line_no long, payload string")
    lines = audit.build_chain(events).select("file", "line_no", F.col("line").alias("raw"), F.get_json_object("line", "$.prev_hash").alias("prev_hash"), F.lit(True).alias("parses"))
    got = audit.verify_chain(lines).first()
    assert (got["events"], got["breaks"], got["boundary"]) == (29, 0, "first")


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 1000])
def test_segments_of_any_size_give_one_verdict(spark, segment):
    rows = chain([*"abcdefgh"], ["bad", "x"], [*"ijklmnop"], [*"qrs"], legacy=(3,))
    rows = [(*r[:2], r[2].upper(), *r[3:]) if r[2] in "bgm" else r for r in rows if r[2] != "k"]
    lines = spark.createDataFrame(rows, LINES).repartition(4)
    whole = sorted(map(tuple, audit.verify_chain(lines, 10**9).collect()))
    assert sorted(map(tuple, audit.verify_chain(lines, segment).collect())) == whole and sum(r[2] for r in whole) == 4
    indexed = spark.createDataFrame([("d0.jsonl", 9), ("d3.jsonl", 5)], "file string, indexed long")
    assert sorted(map(str, audit.chain_smoke(lines, indexed, segment).collect())) == sorted(map(str, audit.chain_smoke(lines, indexed, 10**9).collect()))


def test_redaction_of_nested_values(spark):
    cases = {
        '{"a": {"b": [{"secret": [1]}, "sk-1", "x sk-1", [["sk-2", {"token": 1}], 2]]}, "apiKey": null}': '{"a":{"b":[{"secret":"[REDACTED]"},"[REDACTED]","x sk-1",{"0":["[REDACTED]",{"token":"[REDACTED]"}],"1":2}]},"apiKey":"[REDACTED]"}',
        '{"t": "Bearer\\tx", "f": 1.0e5, "u": "\\u0073k-a"}': '{"t":"[REDACTED]","f":1.0e5,"u":"[REDACTED]"}',
        ' {"plain": 1.50}': ' {"plain": 1.50}', '["sk-1"]': None, "no json": None, '{"token": ': None, "{}": "{}", '{"APIKEY": "x", "tokens": 1, "sk-": "ok"}': '{"APIKEY":"x","tokens":1,"sk-":"ok"}',
    }
    for text, want in cases.items():
        assert one(spark, filters.redacted_json(F.col("t")), t=text) == want
    assert one(spark, filters.redacted_json(F.col("t")), t=None) is None


def test_anchor_is_written_once_and_detects_rewriting(spark):
    lines = spark.createDataFrame(chain(["a", "b"], ["c"]), LINES)
    none = spark.createDataFrame([], "n int, total long, head string, anchor_hash string")
    first = audit.append_anchor(lines, none)
    row = first.first()
    assert row["n"] == 1 and row["total"] == 3 and row["prev_hash"] is None
    assert audit.append_anchor(lines, first.select("n", "total", "head", "anchor_hash")).count() == 0
    assert audit.verify_anchors(first, lines).first()["verdict"] == "ok"
    longer = spark.createDataFrame(chain(["a", "x"], ["y", "z"]), LINES)
    assert audit.verify_anchors(first, longer).first()["verdict"] == "REWRITTEN"
    assert audit.verify_anchors(first, lines.limit(2)).first()["verdict"] == "TRUNCATED"
    assert audit.verify_anchors(first.withColumn("head", F.lit("x")), lines).first()["verdict"] == "SELF_HASH"


def test_spool_codes(spark):
    files = spark.createDataFrame([("a", "1", 2), ("b", "1", 2), ("c", "1", 2), ("d", "1", 2)], "file string, sha string, lines int")
    manifests = spark.createDataFrame([("a", "1", 2, False), ("b", "2", 3, False), ("d", "9", 9, True), ("e", "1", 1, False)], "file string, sha string, emitted int, malformed boolean")
    traced = spark.createDataFrame([("a", "7")], "file string, sha string")
    got = {r["file"]: r["codes"] for r in audit.reconcile_spool(files, manifests, traced).collect()}
    assert got == {"a": ["SPOOL_TRACE_MISMATCH"], "b": ["SPOOL_HASH_MISMATCH", "SPOOL_COUNT_MISMATCH"], "c": ["SPOOL_MANIFEST_MISSING"], "d": ["SPOOL_MANIFEST_MALFORMED"], "e": ["SPOOL_FILE_MISSING"]}


# --- text ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("title", ["Self-Attention", "  Élan vital!! ", "", "a__b  c", "Ünï"])
def test_page_ids_are_version_five(spark, title):
    assert one(spark, T.uuid5("t"), t=title) == str(uuid.uuid5(uuid.UUID(T.PAGE_NAMESPACE), title))


def test_slug_rules_differ(spark):
    t = "My_Note (v2).MD"
    assert one(spark, T.slug_file("t"), t=t) == "my-note-v2.md"
    assert one(spark, T.slug_file("t"), t="???.md") == "source.md"
    assert one(spark, T.slug_page("t"), t="???") == "item"
    assert one(spark, T.slug_link("t"), t="???") == ""
    assert one(spark, T.slug_title("t"), t="a/b & c") == "a-b-c"
    assert len(one(spark, T.slug_title("t"), t="x" * 200)) == 80


def test_slugs_are_those_of_the_rules(spark):
    rng = random.Random(15)
    parts = ["a", "Bc", "9", "-", "--", "_", " ", "\t", "\n", "\r\n", "\x0b", ".", "..", ".Md", "é", "\u212a", "\u0130", "\u2028", "!?", "日本", "x" * 40]
    names = [None, "", ".", ".md", "a..md", "-.md", "- .- x", "a-.-b", "\u212a", *("".join(rng.choices(parts, k=rng.choice([2, 6, 30, 300]))) for _ in range(400))]

    def dashed(t, other):
        return re.sub("-+", "-", re.sub("[^a-z0-9-]", other, re.sub(r"[ \t\n\x0b\f\r_]+", "-", t.lower())))

    def link(t):
        return re.sub(r"^-|-\Z", "", dashed(t, ""))

    def want(t):
        m = re.search(r"[^.](\.[^.]*)\Z", t)
        return ((link(t[: m.start(1)] if m else t) or "source") + (m.group(1).lower() if m else ""), link(t) or "item", re.sub(r"^-+|-+\Z", "", dashed(t, "-"))[:80], link(t))

    rows = spark.createDataFrame(list(enumerate(names)), "n int, t string")
    rules = ("file_slug", "page_slug", "title_slug", "link_slug")
    for made in (T.slugs(rows, "t").select("n", *rules), rows.select("n", T.slug_file("t"), T.slug_page("t"), T.slug_title("t"), T.slug_link("t"))):
        for n, *got in made.collect():
            assert tuple(got) == (want(names[n]) if names[n] is not None else (None,) * 4), names[n]


def test_four_slugs_take_few_passes(spark):
    from tests.conftest import SF
    from tomelight import catalog

    plan = catalog.queries()["slugify_variants"](ship(spark), SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") <= 6  # 28 before, as each slug began again and named itself twice


def test_cards_are_cut_at_headings_after_newlines(spark):
    rng = random.Random(16)
    parts = ["## Question", "## Answer", "## Question one", "## Answer\n", "\n", "\n", "\r\n", "\r", "\u2028", "\x85", " ", "\t", "x", "é y", "\n\n## Question\n", "\n## Answer\n"]
    bodies = [None, "", "## Question\n## Answer\na", "## Question\nq\n## Answer", "## Question\nq\u2028## Answer\nnot yet\n## Answer\na", "## Question\n \n## Answer\na\n## Question\nq\n## Answer\nb", *("".join(rng.choices(parts, k=rng.choice([4, 9, 30]))) for _ in range(500))]

    def want(body):
        m = re.search(r"(?m)^## Question[^\n]*\n([\s\S]*?)^## Answer[^\n]*\n([\s\S]*)", body or "")
        cut = [re.sub("\r?\n", "<br>", x.strip(" \t\n\x0b\f\r").replace("\t", "    ")) for x in m.groups()] if m else [""]
        return tuple(cut) if all(cut) else None

    cards = spark.createDataFrame([(n, "My Topic.md", "s/x", b) for n, b in enumerate(bodies)], "path int, topic string, source string, body string")
    got = {r["path"]: (r["question"], r["answer"]) for r in exports.anki_cards(cards).collect()}
    assert got == {n: want(b) for n, b in enumerate(bodies) if want(b)} and len(got) > 50
    assert {r["tags"] for r in exports.anki_cards(cards, "My Topic.md").collect()} == {"topic:my-topic source:s-x"} and exports.anki_cards(cards, "other").count() == 0


def test_cards_are_cut_once(spark):
    from tests.conftest import SF
    from tomelight import catalog

    plan = catalog.queries()["anki_export"](ship(spark), SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and r"[\s\S]" not in plan  # the filter on both fields made them once more, by patterns


FM = "---\ntitle: \"A: b\"\ntags:\n  - x\n  - 'y'\nempty: []\nurl: http://h:1/\ntitle: second\n---\n\n  Body"


def test_front_matter_modes(spark):
    flat = one(spark, T.fm_flat("t"), t=FM)
    assert flat["title"] == "second" and flat["url"] == "http://h:1/"
    assert one(spark, T.fm_field("t", "title"), t=FM) == "A: b"
    assert one(spark, T.fm_list("t", "tags"), t=FM) == ["x", "y"] and one(spark, T.fm_list("t", "empty"), t=FM) == []
    assert one(spark, T.fm_body("t"), t=FM) == "Body"
    assert one(spark, T.fm_body("t"), t="plain") == "plain"
    changed = one(spark, T.fm_set("t", "url", "new"), t=FM)
    assert "url: new\n" in changed and one(spark, T.fm_set("t", "url", "new"), t=changed) == changed
    assert one(spark, T.fm_set("t", "added", "1"), t=FM).startswith("---\nadded: 1\n")


@pytest.mark.parametrize(
    ("content", "code"),
    [
        ("", "EMPTY_OUTPUT"),
        ("I cannot help with that request today.", "REFUSAL_DETECTED"),
        ("x" * 400 + " I cannot", "NON_MARKDOWN_JUNK"),
        ("---\ntitle: I cannot\n---\n" + "b" * 20, None),
        ("---\ntitle: t\n---\n" + "b" * 19, "BODY_TOO_SHORT"),
        ("---\nnever closed", "BODY_TOO_SHORT"),
        ("just some words without structure at all", "NON_MARKDOWN_JUNK"),
        ("# Head\nand twenty characters of body", None),
    ],
)
def test_output_codes(spark, content, code):
    assert one(spark, filters.output_code(F.col("t")), t=content) == code


@pytest.mark.parametrize(
    ("text", "kind", "match"),
    [
        ("a 60/40 split", "comp", "60/40 split"), ("a 60/40\u00a0 share.", "comp", "60/40  share"), ("x60/40 split", None, None), ("60/40 splits", None, None), ("1234/40 split", None, None), ("7-bucket", "comp", "7-bucket"), ("17 bucket", None, None), ("7 buckets", None, None),
        ("revenue-share 50%", "comp", "revenue-share 5"), ("myrevenue share9", "comp", "revenue share9"), ("revenue-share", None, None), ("Equity 25% each", "comp", "Equity 2"), ("inequity grants", "comp", "equity grants"), ("equity stakeholder", "comp", "equity stake"), ("equity", None, None),
        ("Vesting.", "comp", "Vesting"), ("investing", None, None), ("RSUs", "comp", "RSUs"), ("RSUx", None, None), ("mystock option", "comp", "stock option"), ("stock optional", None, None), ("a strike price", "comp", "strike price"), ("strike prices", None, None), ("salary", "comp", "salary"), ("salaryman", None, None),
        ("baseBase pay", "comp", "Base pay"), ("base payment", None, None), ("take home pay", "comp", "take home pay"), ("sign-on  bonus", "comp", "sign-on  bonus"), ("relaunch bonus", "comp", "launch bonus"), ("launch bonuses", None, None),
        ("SSN and salary", "comp", "salary"), ("123-45-6789", "pii", "123-45-6789"), ("0123-45-6789", None, None), ("123-45-67890", None, None), ("ssn", "pii", "ssn"), ("assn", None, None), ("unsocial security no", "pii", "social security no"), ("social security note", None, None),
        ("background check passed", "pii", "background check passed"), ("background-check results", None, None), ("date of birthday", None, None), ("update of birth", "pii", "date of birth"), ("DOB: x", "pii", "DOB:"), ("DOB:1990-01-01", "pii", "DOB:"), ("dob = 1", "pii", "dob ="), ("xDOB: 1", None, None), ("DOB 1990", None, None),
        ("１２３-４５-６７８９", "pii", "123-45-6789"), ("Ⓢalary", "comp", "Salary"), ("oﬃce of the ＳＳＮ", "pii", "SSN"), ("oﬃce", None, None), ("salary\u0301", None, None), ("DOB\u3000:", "pii", "DOB :"), (None, None, None), ("", None, None),
    ],
)
def test_disclosure(spark, text, kind, match):
    found = one(spark, filters.disclosure(F.col("t")), t=text)
    assert (found.category, found.match) == (kind, match) if kind else found is None


def test_disclosures_are_found_as_without_the_check_of_starts(spark):
    def pattern(phrases):
        each = (("(?<![A-Za-z0-9_])" if a else "") + words + ("(?![A-Za-z0-9_])" if b else "") for words, a, b in phrases)
        return re.compile("(" + "|".join(each).replace(r"\s", f"[{T.SPACE}]") + ")", re.IGNORECASE | re.ASCII)

    comp, pii = pattern(filters.COMPENSATION), pattern(filters.PERSONAL)
    rng = random.Random(17)
    parts = "1 12 123 1/2 50/50 split share 7 - bucket revenue equity stakes grant option vesting RSU rsus stock options strike price Salary base pay take home launch signing sign on bonus 123-45-6789 SSN social security number no background check passed date of birth DOB : = x é _".split() + [" ", " ", "\u00a0", "\n", "-"]
    texts = ["".join(x + rng.choice(["", " ", " ", "-"]) for x in rng.choices(parts, k=rng.choice([2, 4, 8]))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", filters.disclosure(F.col("t")).alias("f")).collect()
    kinds = set()
    for n, f in rows:
        t = texts[n].replace("\u00a0", " ")
        c, p = comp.search(t), pii.search(t)
        assert f == (("comp", c.group()) if c else ("pii", p.group()) if p else None), texts[n]
        kinds.add(f and f[0])
    assert kinds == {"comp", "pii", None}


def test_disclosures_are_looked_for_once(spark):
    from tests.conftest import SF
    from tomelight import catalog

    plan = catalog.queries()["disclosure_scan"](ship(spark), SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 2  # 4 before: one to compare and one to return, of either kind


def test_class_of_changing_characters_is_a_lookup():
    before = re.compile(r"[^\x00-\x9f¡-§©«¬®°±¶·»¿-ÿ]")
    assert all(bool(before.match(chr(c))) == bool(re.match(T._MAY_CHANGE, chr(c))) for c in range(0x11000))
    assert not re.search("[^x]-", T._MAY_CHANGE) and "A-Z" not in T.WORD_START + T.WORD_END


def test_compatibility_form(spark):
    from tomelight.functions.text import nfkc

    texts = ["a", "e\u0301", "\u1100\u1161\u11a8", "q\u0307\u0323", "ﬁ½²", "é", "\u212b", "ｶﾞ", None, "日本"]
    import unicodedata

    for t in texts:
        assert one(spark, nfkc(F.col("t")), t=t) == (t if t is None else unicodedata.normalize("NFKC", t))


def test_citations_as_the_answer_has_them(spark):
    text = "Two  spaces stay [source: Page A]\t[source: page a ]\r\n [source:\u00a0PAGE A]  Two  spaces stay\n\tTab\tin [source: ]it[source:]\n Two  spaces stay [source: Page A]\t[source: page a ]\nAgain [source: B[1]\n[source: no\nend]"
    answers = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "answer_id long, text string")
    titles = spark.createDataFrame([("a1", " PAGE a\t", 1), ("a2", "page A", 2), ("b", "b[1", 1)], "path string, title string, ord long")
    got = lineage.parse_citations(answers, titles)
    assert [tuple(r) for r in got.orderBy("n").collect()] == [
        (1, 1, "Page A", "Two  spaces stay", "a2"), (1, 2, "PAGE A", "Two  spaces stay", "a2"), (1, 3, "", "Tab\tin it[source:]", ""), (1, 4, "B[1", "Again", "b"),
    ]
    pages = spark.createDataFrame([("a2", "---\nsource_path: raw/x.md\r\n: y\n---\nbody"), ("b", "no front matter")], "path string, raw string")
    chain = lineage.provenance_chain(answers, got, pages).orderBy("answer_id", "step").collect()
    assert [tuple(r) for r in chain] == [
        (1, 0, "answer", "(generated answer)", "Generated Answer"), (1, 1, "compiled-page", "a2", "Page A"), (1, 2, "raw-source", "raw/x.md", "raw/x.md"), (1, 3, "compiled-page", "b", "B[1"),
        (2, 0, "answer", "(generated answer)", "Generated Answer"), (3, 0, "answer", "(generated answer)", "Generated Answer"),
    ]


def test_promotion_first_failing_rule_wins(spark):
    code = lambda **k: spark.range(1).select(filters.promotion_code(*(F.lit(k.get(n, d)) for n, d in (("path", "outputs/r.md"), ("exists", True), ("size", 5), ("title", "T"), ("kind", "topic"), ("confirmed", True), ("target", False))))).first()[0]
    assert code() is None
    assert code(path="wiki/x.md", exists=False) == "INELIGIBLE_PATH"
    assert code(path="outputs/tasks/1/drafts/x.md") == "DRAFT_REJECTED"
    assert code(exists=False, size=0) == "FILE_NOT_FOUND"
    assert code(size=0, title="") == "EMPTY_FILE"
    assert code(title=" ", kind="x") == "MISSING_FRONTMATTER"
    assert code(kind="x", confirmed=False) == "INVALID_TYPE"
    assert code(confirmed=False, target=True) == "NOT_CONFIRMED"
    assert code(target=True) == "TARGET_EXISTS"


def test_html_metadata_branches(spark):
    pages = spark.createDataFrame(
        [
            (1, '<TITLE> T </TITLE><link rel="canonical" href="c1"><meta name="author" content="A"><body><p>x <b>y</b></p><script>no</script></body>'),
            (2, '<link href="c2" rel="canonical"><meta content="B" property="article:author"><time datetime="2024-01-01">'),
            (3, '<meta property="og:url" content="c3">'),
            (4, "nothing"),
        ],
        "id int, html string",
    )
    got = {r["id"]: r for r in readers.parse_html(pages).collect()}
    assert (got[1]["title"], got[1]["canonical"], got[1]["author"], got[1]["text"]) == ("T", "c1", "A", "x y")
    assert (got[2]["canonical"], got[2]["author"], got[2]["date"]) == ("c2", "B", "2024-01-01")
    assert got[3]["canonical"] == "c3" and got[4]["title"] is None and got[4]["text"] == "nothing"


def test_file_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("---\ntitle: One\n---\n# Head\ntext")
    (tmp_path / "b.md").write_text("# Two\nbody")
    (tmp_path / "c.txt").write_text("skip")
    got = readers.parse_markdown(readers.read_markdown(spark, str(tmp_path)))
    assert sorted(r["title"] for r in got.collect()) == ["One", "Two"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.jsonl").write_text('{"a":1}\n\nnot json\n{"a":2}\n')
    lines = readers.read_log_lines(spark, str(tmp_path / "log"))
    assert sorted((r["raw"], r["parses"]) for r in lines.collect()) == [("not json", False), ('{"a":1}', True), ('{"a":2}', True)]
    assert readers.read_jsonl(spark, str(tmp_path / "log"), "a int").count() == 2


def test_spool_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("wiki/a.md", "concept", "A", "body"), ("wiki/b.md", "semantic-index", "B", "x"), ("wiki/c.md", "topic", "", " "), ("wiki/d.md", "topic", "D", "x" * 70_000)], "path string, type string, title string, body string")
    c = exports.spool_candidates(pages, "ws")
    assert {r["path"]: r["reject"] for r in c.collect()} == {"wiki/a.md": None, "wiki/b.md": "SEMANTIC_INDEX_SKIPPED", "wiki/c.md": "EMPTY_CONTENT", "wiki/d.md": "CONTENT_TOO_LARGE"}
    manifest = exports.write_spool(exports.spool_lines(c, "t", "2024-01-01T00:00:00.000Z"), str(tmp_path / "spool")).filter("emittedCount > 0").collect()
    row = spark.read.json(str(tmp_path / "spool")).first()
    assert row["content"] == "body" and row["metadata"]["filePaths"] == ["wiki/a.md"] and not row["prePolicyFlags"]["potentialSecret"] and row["trustLevel"] == "medium"
    raw = (tmp_path / "spool" / manifest[0]["spoolFile"]).read_bytes()
    assert [(m["emittedCount"], m["spoolFileBytes"], m["spoolFileSha256"]) for m in manifest] == [(1, len(raw), hashlib.sha256(raw).hexdigest())]


# --- search -------------------------------------------------------------------------------------


def test_bm25_equals_sqlite(spark):
    docs = [("a", "apple pie", "x", "apple banana banana"), ("b", "other", "y", "banana cherry"), ("c", "third", "z", "cherry cherry apple"), ("d", "fourth", "w", "nothing here")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, title, tags, body, tokenize='unicode61')")
    db.executemany("insert into t values (?,?,?,?)", docs)
    pages = spark.createDataFrame(docs, "path string, title string, tags string, body string")
    for match, terms in (("apple OR cherry", ["apple", "cherry"]), ("banana", ["banana"])):
        want = {p: round(r, 6) for p, r in db.execute("select path, bm25(t) from t where t match ?", (match,))}
        query = spark.createDataFrame([(x,) for x in terms], "term string")
        assert {r["path"]: round(r["rank"], 6) for r in search.search(pages, query, 10, match_all=False).collect()} == want
    both = spark.createDataFrame([("apple",), ("cherry",)], "term string")
    assert [r["path"] for r in search.search(pages, both, 10).collect()] == ["c"]
    none = spark.createDataFrame([("pie",), ("nothing",)], "term string")
    assert {r["path"] for r in search.strict_then_broad(pages, none).collect()} == {"a", "d"}


def test_title_and_type_boost(spark):
    pages = spark.createDataFrame([("a", "zebra", "topic", "", "zebra word"), ("b", "none", "entity", "", "zebra zebra word")] + [(f"x{k}", "n", "entity", "", "filler text") for k in range(9)], "path string, title string, type string, tags string, body string")
    q = spark.createDataFrame([("zebra",)], "term string")
    assert [r["path"] for r in search.rerank(pages, q, "analytical", 2).collect()][0] == "a"


@pytest.mark.parametrize(("q", "kind"), [("Compare a and b", "comparative"), ("Explain the difference", "comparative"), ("why so", "analytical"), ("What is x", "factual"), ("vsx whyever", "open-ended")])
def test_question_type(spark, q, kind):
    assert one(spark, search.question_type(F.col("q")), q=q) == kind


def test_question_tokens(spark):
    assert one(spark, search.analysis_tokens("q"), q="What is the core's foo,bar-baz?") == ["core", "foo", "bar", "baz"]
    assert one(spark, search.search_tokens("q"), q="What is foo,bar-baz?") == ["foobar", "baz"]


# --- lineage, learning, cost --------------------------------------------------------------------


def test_orphans_and_backlinks(spark):
    pages = spark.createDataFrame(
        [("p1", "concepts", "one", "[[Two Words|alias]] [[one]]", 1), ("p2", "topics", "two-words", "[[missing]]", 2), ("p3", "sources", "src", "", 3), ("p4", "topics", "index", "", 4), ("p5", "topics", "two", "", 5)],
        "path string, dir string, slug string, body string, ord long",
    )
    assert {r["path"] for r in lineage.orphan_pages(pages).collect()} == {"p2", "p5"}
    assert [(r["slug"], r["referrer"], r["ord"], r["n"]) for r in lineage.backlinks(pages).collect()] == [("one", "one", 1, 1)]


def test_affected_set_sweeps(spark):
    sources = spark.createDataFrame([("s1", "a", "h1", "t1", 1), ("s2", "b", "h2", "t1", 2)], "id string, path string, hash string, ingested_at string, ord long")
    comp = spark.createDataFrame([("c1", "s1", "summary", "o1"), ("c2", None, "topic", "o2"), ("c3", None, "contradiction", "o3")], "id string, source_id string, type string, output_path string")
    junction = spark.createDataFrame([("c2", "s1")], "compilation_id string, source_id string")
    run = lambda *ch: {r["id"]: r["reason"] for r in lineage.affected_set(spark.createDataFrame(list(ch), "path string, hash string"), sources, comp, junction).collect()}
    assert run(("a", "h1")) == {}
    assert run(("a", "new")) == {"c1": "source-changed", "c2": "cited-source-changed"}
    assert run(("b", "new")) == {"c2": "uncited-source-sweep", "c3": "uncited-source-sweep"}
    assert run(("zz", "x")) == {"c2": "new-source-sweep", "c3": "new-source-sweep"}


@NO_FIXTURE
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.booleans(), st.integers(0, 23)), min_size=1, max_size=40))
def test_retention_properties(spark, rows):
    df = spark.createDataFrame([(c, ok, f"2024-01-01T{h:02d}", n) for n, (c, ok, h) in enumerate(rows)], "concept string, correct boolean, tested_at string, ord long")
    got = learn.retention_by_concept(df).collect()
    assert sum(r["total"] for r in got) == len(rows) and all(0 <= r["retention"] <= 1 for r in got)
    weak = learn.weak_areas(df, least=2, most=0.5).collect()
    assert [(r["retention"], -r["total"], r["concept"]) for r in weak] == sorted((r["retention"], -r["total"], r["concept"]) for r in got if r["total"] >= 2 and r["retention"] <= 0.5)


def test_names_are_in_the_order_people_expect(spark):
    names = ["zebra", "Apple", "apple", "Éclair", "eclair", "Zoo", "\u00e4pfel", "b-c", "bc"]
    rows = spark.createDataFrame([(n, False, "2024-01-01") for n in names], "concept string, correct boolean, tested_at string")
    got = [r["concept"] for r in learn.weak_areas(rows).collect()]
    assert got.index("apple") < got.index("Apple") < got.index("eclair") < got.index("Éclair") < got.index("zebra") < got.index("Zoo") and got.index("\u00e4pfel") < got.index("bc")


def test_cost_gate_decisions(spark):
    comp = spark.createDataFrame([("topic", "m", 1000, "2024-01-01T00:00:00.000Z"), ("topic", "m", 3000, "2024-01-02T00:00:00.000Z")], "type string, model string, tokens_used long, compiled_at string")
    affected = spark.createDataFrame([("topic",), ("novel",)], "type string")
    gate = lambda **k: cost.cost_gate(affected, comp, "2024-01-01", "2024-01-02", "deepseek-x", **k).first()
    row = gate(ceiling=100.0)
    assert row["decision"] == "proceed" and abs(row["spent"] - (700 * 3 + 300 * 15) / 1e6) < 1e-12
    assert gate(ceiling=row["total"])["decision"] == "proceed"  # the ceiling itself is allowed
    assert gate(ceiling=row["total"] - 1e-9)["decision"] == "defer"
    assert gate(ceiling=0.0, elapsed=5.0, window=10.0)["decision"] == "coalesce"
    assert gate(ceiling=0.0, elapsed=10.0, window=10.0)["decision"] == "defer"


def test_merge_keeps_first_longest_and_id_order(spark):
    pages = spark.createDataFrame([("A b", "xx", ["2", "1"], 1), ("a-B!", "yyy", ["1", "3"], 2), ("A B", "zzz", ["9"], 3)], "title string, page string, ids array<string>, ord long")
    row = merge.merge_pages(pages).first()
    assert row["page"] == "yyy" and row["ids"] == ["2", "1", "3", "9"] and row["id"] == str(uuid.uuid5(uuid.UUID(T.PAGE_NAMESPACE), "a-b"))


def test_seeded_sample_is_stable(spark):
    c = spark.createDataFrame([(f"c{k}", False, "wiki/topics/x", "t") for k in range(50)], "id string, stale boolean, output_path string, compiled_at string")
    ids = lambda seed: [r["id"] for r in merge.sample_compilations(c, c, 5, "topics", seed).collect()]
    assert ids(1) == ids(1) and ids(1) != ids(2)


def test_task_transitions_quirk(spark):
    e = spark.createDataFrame([("t", "rendering", 1), ("t", "failed_rendering", 2), ("t", "critiquing", 3)], "task string, status string, ord long")
    assert [r["valid"] for r in filters.task_transitions(e).orderBy("ord").collect()] == [False, True]


def test_rubric_and_floor(spark):
    rows = spark.createDataFrame([(1, [("a", 5.0), ("b", 3.0)]), (2, [("a", 5.0)]), (3, [("a", 5.0), ("a", 3.0)]), (4, [("a", 6.0), ("b", 1.0)])], "id int, scores array<struct<criterion: string, score: double>>")
    assert {r["id"]: r["score"] for r in evals.rubric(rows, ["b", "a"]).collect()} == {1: 0.8, 2: None, 3: None, 4: None}
    s = spark.createDataFrame([("p", 0.9), ("w", 0.7), ("r", 0.5), ("n", 0.1)], "name string, score double")
    f = spark.createDataFrame([("p", 0.6), ("w", 0.6), ("r", 0.6)], "name string, floor double")
    assert {r["name"]: r["status"] for r in evals.floor_gate(s, f).collect()} == {"p": "pass", "w": "warning", "r": "regression", "n": "recorded"}


def test_batches_without_size_make_one(spark):
    df = spark.createDataFrame([(k, "g") for k in range(5)], "n int, g string")
    assert {r["batch"] for r in ingest.batches(df, "n", 0, "g").collect()} == {0}
    assert [r["batch"] for r in ingest.batches(df, "n", 2, "g").orderBy("n").collect()] == [0, 0, 1, 1, 2]


# --- streams ------------------------------------------------------------------------------------


def test_streamed_traces(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"event_id": k, "ts": f"2024-01-0{1 + k % 3}T00:00:0{k % 10}Z", "user_id": 1, "event_type": "click"} for k in range(9)]
    (folder / "a.jsonl").write_text("\n".join([*map(json.dumps, lines), json.dumps(lines[0]), "not json"]))
    events = traces.follow_traces(spark, str(folder))
    q = traces.first_seen(events).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 9
    q = traces.daily_counts(events).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("daily").collect()) == [3, 3, 4]


def test_streamed_impact(spark, tmp_path):
    sources = spark.createDataFrame([("s1", "a", "h1", "t1", 1)], "id string, path string, hash string, ingested_at string, ord long")
    comp = spark.createDataFrame([("c1", "s1", "summary", "o1")], "id string, source_id string, type string, output_path string")
    junction = spark.createDataFrame([], "compilation_id string, source_id string")
    folder = tmp_path / "ch"
    folder.mkdir()
    (folder / "x.json").write_text('{"path":"a","hash":"new"}\n{"path":"a","hash":"new"}\n')
    seen = []
    changes = spark.readStream.schema("path string, hash string").json(str(folder))
    sink = traces.impact_sink(sources, comp, junction, lambda df, _: seen.extend(r["id"] for r in df.collect()))
    changes.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start().awaitTermination()
    assert seen == ["c1"]


def test_streamed_debounce_equals_the_batch_fold_over_restarts(spark, tmp_path):
    import random

    rng = random.Random(8)
    rows, at = [], 0
    for n in range(400):
        at += rng.choice([0, 1, 400, 3000, 90_000])
        rows.append((rng.randrange(5), n, at))
    events = spark.createDataFrame(rows, "key long, event_id long, ms long")
    want = sorted(map(tuple, merge.debounce(events.withColumnRenamed("key", "user_id"), 100_000).collect()))
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for part in range(4):  # each part is a run of its own, which starts from the checkpoint of the one before
        own = "".join(json.dumps({"key": k, "event_id": n, "ms": ms}) + "\n" for k, n, ms in rows[100 * part : 100 * part + 100])
        (folder / f"{part}.json").write_text(own)
        lines = spark.readStream.schema("key long, event_id long, ms long").json(str(folder))
        timed = lines.select("key", "event_id", F.timestamp_millis("ms").alias("ts"))
        stream = traces.debounced(timed, 100_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        assert stream.exception() is None and not stream.isActive
    got = sorted(map(tuple, spark.read.parquet(out).select("key", "event_id", "ms", "accepted").collect()))
    assert got == want and 0 < sum(r[3] for r in got) < len(got)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(ship(spark)).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
