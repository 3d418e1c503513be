"""Record keeping: mounts, provenance, audit rows, promotions, tasks, specs, composed files and bundles.

Writers return the rows or lines that are to be added; the ``write_`` functions append them with
Spark's commit protocol.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.yaml import yaml_json
from .cost import pricing_model
from .cost import rate as model_rate
from .filters import TRANSITIONS

# States, codes, kinds of specs, directories of promoted pages, reasons to stop.
EVAL_TYPES = ("retrieval", "smoke", "citation", "functional-quality", "compilation", "faithfulness")
AUTH_MARKS = ("authentication_error", "HTTP 401", "invalid_api_key", "permission_error", "HTTP 403")
RETRYABLE = ("REFUSAL_DETECTED", "NON_MARKDOWN_JUNK", "SCHEMA_INVALID")
TRUNCATED = ("max_tokens", "length")
PROMOTED_DIRS = {"topic": "topics", "concept": "concepts", "entity": "entities", "reference": "sources"}
SUPPORTED = r"(?i)\.(md|mdx|pdf|html|htm|txt)$"
#: Bytes of lines that a slice of a spool file holds.
SLICE_BYTES = 4 << 20
DOC_CLASS = "^[0-9]{3}-([A-Z]{2}-[A-Z]{4})-"


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


# --- mounts and listings ------------------------------------------------------------------------


def register_mounts(new: DataFrame, mounts: DataFrame) -> DataFrame:
    """name, path, ord, outcome of ``new`` (name, path, exists, ord): missing, duplicate or registered.

    A name that ``mounts`` has, or that an earlier existing row of ``new`` takes, is a duplicate.
    """
    first = new.filter("exists").groupBy("name").agg(F.min("ord").alias("_first"))
    taken = mounts.select("name", F.lit(True).alias("_taken")).distinct()
    j = new.join(first, "name", "left").join(taken, "name", "left")
    outcome = F.when(~F.col("exists"), "missing").when(F.col("_taken").isNotNull() | (F.col("ord") != F.col("_first")), "duplicate").otherwise("registered")
    return j.select("name", "path", "ord", outcome.alias("outcome"))


def remove_mounts(mounts: DataFrame, gone: DataFrame) -> DataFrame:
    """``mounts`` without the identifiers in ``gone``."""
    return mounts.join(gone.select("id").distinct(), "id", "left_anti")


def supported_files(paths: DataFrame) -> DataFrame:
    """The rows of ``paths`` whose file a folder scan takes: no hidden part, no module folder, a known extension."""
    return paths.filter(~F.col("path").rlike(r"(^|/)(\.[^/]*|node_modules)(/|$)") & F.col("path").rlike(SUPPORTED))


def batch_summary(states: DataFrame) -> DataFrame:
    """One row: total, ingested, already_ingested, skipped of ingest states."""
    known = F.col("state")
    return states.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(known.isin("ingest", "reingest")).alias("ingested"), F.count_if(known == "unchanged").alias("already_ingested"), F.count_if(known == "too-large").alias("skipped")
    )


def changed_files(lists: DataFrame, latest: DataFrame) -> DataFrame:
    """list_id, n, path, hash for lists of changed paths, split at commas and line ends.

    Repeats go, order stays; a path that ``latest`` (path, hash) lacks has an empty hash, so that it
    counts as changed.
    """
    paths = F.array_distinct(F.array_remove(F.transform(F.split("arg", "[\n,]"), lambda x: F.trim(x)), ""))
    each = lists.select("list_id", F.posexplode(paths).alias("n", "path"))
    return each.join(latest.select("path", "hash"), "path", "left").select("list_id", "n", "path", F.coalesce("hash", F.lit("")).alias("hash"))


# --- provenance and audit -----------------------------------------------------------------------


def provenance_lines(records: DataFrame) -> DataFrame:
    """source_id, line, event of records (source_id, output_path, output_type, operation, recorded_at).

    The identifier comes from the record, so a job that runs again writes the same lines; the event
    is what the trace gets.
    """
    name = F.concat_ws("\0", "source_id", "output_path", "output_type", "operation", "recorded_at")
    what = (F.col("source_id").alias("sourceId"), F.col("output_path").alias("outputPath"), F.col("output_type").alias("outputType"), F.col("operation").alias("operation"))
    line = F.to_json(F.struct(T.uuid5(name).alias("id"), *what, F.col("recorded_at").alias("recordedAt")))
    event = F.to_json(F.struct(F.lit("provenance.record").alias("event_type"), F.struct(*what).alias("payload")))
    return records.select("source_id", line.alias("line"), event.alias("event"))


def write_provenance(records: DataFrame, path: str) -> None:
    """Append each source's lines to its own folder."""
    provenance_lines(records).select("source_id", F.col("line").alias("value")).write.mode("append").partitionBy("source_id").text(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """``events`` (at, operation, summary) with the row of the audit table each adds."""
    bars = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    summary = F.regexp_replace(bars(F.col("summary")), "[\n\r]", " ")
    return events.withColumn("row", F.concat(F.lit("| "), F.col("at"), F.lit(" | "), bars(F.col("operation")), F.lit(" | "), summary, F.lit(" |")))


def read_anchors(lines: DataFrame) -> DataFrame:
    """ord, total, head, prev_hash, anchor_hash, malformed of anchor lines; a malformed one keeps its place."""
    schema = "totalEvents long, chainHead string, prevAnchorHash string, anchorHash string"
    j = F.from_json("line", schema)
    # Spark's parser stops at the end of the first value, so what follows it is looked at apart.
    object_only = F.col("line").rlike(r"^\s*\{[\s\S]*\}\s*$")
    whole = lines.filter(F.trim("line") != "").select("ord", j.alias("j"), (F.try_parse_json("line").isNull() | ~object_only).alias("malformed"))
    return whole.select("ord", *(F.when(~F.col("malformed"), F.col(f"j.{a}")).alias(b) for a, b in (("totalEvents", "total"), ("chainHead", "head"), ("prevAnchorHash", "prev_hash"), ("anchorHash", "anchor_hash"))), "malformed")


def record_tokens(compilations: DataFrame, uses: DataFrame) -> DataFrame:
    """id, judge_tokens, error: rounded uses (id, tokens) summed onto what a compilation has.

    A negative or unfinished number is an error and so is an unknown identifier; neither is counted.
    """
    good = F.col("tokens").isNotNull() & ~F.isnan("tokens") & (F.col("tokens") >= 0) & (F.col("tokens") < float("inf"))
    sums = uses.groupBy("id").agg(F.sum(F.when(good, F.floor(F.col("tokens") + 0.5))).alias("_sum"), F.count_if(~good).alias("_bad"))
    j = compilations.select("id", "judge_tokens", F.lit(True).alias("_known")).join(sums, "id", "full_outer")
    error = F.when(F.col("_known").isNull(), "UNKNOWN_ID").when(F.col("_bad") > 0, "BAD_NUMBER")
    after = F.when(F.col("_sum").isNull(), F.col("judge_tokens")).otherwise(F.coalesce("judge_tokens", F.lit(0).cast("long")) + F.col("_sum"))
    return j.select("id", F.when(F.col("_known"), after).cast("long").alias("judge_tokens"), error.alias("error"))


# --- promotion and tasks ------------------------------------------------------------------------


def promote(candidates: DataFrame) -> DataFrame:
    """Rows that promotions add for ``candidates`` (path, title, type, code, at) without a code.

    Each has its receipt first: the page appears only where its promotion row does.
    """
    kind = F.element_at(F.create_map(*(F.lit(x) for p in PROMOTED_DIRS.items() for x in p)), F.col("type"))
    slug = T.slug_title("title")
    ok = candidates.filter("code IS NULL")
    target = F.concat(F.lit("wiki/"), kind, F.lit("/"), F.when(slug == "", "item").otherwise(slug), F.lit(".md"))
    return ok.select(T.uuid5(F.concat_ws("\0", "path", "at")).alias("id"), F.col("path").alias("source_path"), target.alias("target_path"), F.col("at").alias("promoted_at"))


def unpromote(promotions: DataFrame, targets: DataFrame) -> DataFrame:
    """path, outcome for ``targets``: the promotion and its page go, or there is none."""
    have = promotions.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("_n"))
    return targets.select("path").distinct().join(have, "path", "left").select("path", F.when(F.col("_n").isNull(), "NOT_PROMOTED").otherwise("removed").alias("outcome"))


def move_tasks(tasks: DataFrame, moves: DataFrame) -> DataFrame:
    """id, status, outcome, completed_at, archived_at after ``moves`` (id, to, at), one a task at most.

    A move that the states do not allow leaves the task as it is.
    """
    j = tasks.select("id", "status").join(moves.select("id", "to", "at"), "id", "right")
    allowed = reduce(lambda a, b: a | b, [(F.col("status") == a) & F.col("to").isin(*b) for a, b in TRANSITIONS.items()])
    outcome = F.when(F.col("status").isNull(), "NOT_FOUND").when(~allowed, "INVALID_TRANSITION").otherwise("moved")
    moved = outcome == "moved"
    stamp = lambda s: F.when(moved & (F.col("to") == s), F.col("at"))
    return j.select("id", F.when(moved, F.col("to")).otherwise(F.col("status")).alias("status"), outcome.alias("outcome"), stamp("completed").alias("completed_at"), stamp("archived").alias("archived_at"))


def task_eligibility(tasks: DataFrame) -> DataFrame:
    """id, eligible, reason of tasks (id, status_json or null, has_output): whether their output may be rendered."""
    status = F.get_json_object("status_json", "$.status")
    readable = F.try_parse_json("status_json").isNotNull()
    reason = (
        F.when(F.col("status_json").isNull(), F.when(F.col("has_output"), "output directory exists").otherwise("no status and no output"))
        .when(~readable, "status is not valid JSON")
        .when(F.coalesce(status, F.lit("undefined")) != "completed", F.concat(F.lit("status is "), F.coalesce(status, F.lit("undefined"))))
        .otherwise("completed")
    )
    return tasks.select("id", reason.isin("completed", "output directory exists").alias("eligible"), reason.alias("reason"))


def task_outputs(eligible: DataFrame, files: DataFrame) -> DataFrame:
    """id, path, title, body of the Markdown files (id, name, raw) of eligible tasks; a file's name stands in for a missing title."""
    own = files.filter(F.col("name").endswith(".md")).join(eligible.filter("eligible").select("id"), "id")
    title = F.coalesce(T.fm_field(T.fm_block("raw"), "title"), F.regexp_replace("name", r"\.md$", ""))
    return own.select("id", F.concat(F.lit("tasks/"), "id", F.lit("/output/"), "name").alias("path"), title.alias("title"), T.fm_body("raw").alias("body"))


def summary_source_ids(compilations: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The distinct sources of summaries, of those at ``paths`` only if given."""
    own = compilations.filter("type = 'summary' AND source_id IS NOT NULL AND source_id <> ''")
    if paths is not None:
        own = own.join(paths.select(F.col("path").alias("output_path")).distinct(), "output_path", "left_semi")
    return own.select("source_id").distinct()


# --- what a model's call came to ----------------------------------------------------------------


def is_auth_error(message: Column) -> Column:
    return reduce(lambda a, b: a | b, [message.contains(m) for m in AUTH_MARKS])


def is_retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def was_truncated(reason: Column) -> Column:
    return F.coalesce(reason.isin(*TRUNCATED), F.lit(False))


def usage_line(input_tokens: Column, output_tokens: Column, model: Column) -> Column:
    """The line that shows a call's tokens and price."""
    price = (input_tokens * model_rate(pricing_model(model), 0) + output_tokens * model_rate(pricing_model(model), 1)) / 1e6
    # ``format_number`` rounds what the double really is, half to even, as C does; ``format_string`` rounds its shortest decimals up.
    shown = F.translate(F.format_number(price.cast("double"), 2), ",", "")
    return F.format_string("Used %,d tokens (~$%s)", (input_tokens + output_tokens).cast("long"), shown)


# --- specs and banks ----------------------------------------------------------------------------


def spec_errors(specs: DataFrame) -> Column:
    """The first thing wrong with an evaluation spec's columns, null if it may be loaded."""
    c = F.col
    out_of_unit = lambda x: c(x).isNotNull() & (F.isnan(c(x)) | (c(x) < 0) | (c(x) > 1))
    none = lambda x: c(x).isNull() | (F.size(c(x)) == 0)
    holes = lambda x: F.exists(c(x), lambda v: v.isNull() | (F.trim(v) == ""))
    of = lambda kind, test: (c("type") == kind) & test
    asks = c("type").isin("retrieval", "functional-quality")
    return (
        F.when(_blank(c("id")), "id: empty")
        .when(_blank(c("name")), "name: empty")
        .when(c("type").isNull() | ~c("type").isin(*EVAL_TYPES), "type: unknown")
        .when(out_of_unit("threshold"), "threshold: not in [0, 1]")
        .when(asks & _blank(c("question")), "question: empty")
        .when(of("retrieval", none("expected_pages")), "expected_pages: empty")
        .when(of("functional-quality", none("expected_substrings")), "expected_substrings: empty")
        .when(of("functional-quality", holes("expected_substrings")), "expected_substrings: empty entry")
        .when(of("functional-quality", none("expected_sources")), "expected_sources: empty")
        .when(of("functional-quality", out_of_unit("recall_floor")), "recall_floor: not in [0, 1]")
        .when(asks & (c("k") < 1), "k: not positive")
        .when(of("retrieval", out_of_unit("min_recall")), "min_recall: not in [0, 1]")
        .when(of("retrieval", out_of_unit("min_precision")), "min_precision: not in [0, 1]")
        .when(of("citation", _blank(c("target_file"))), "target_file: empty")
        .when(of("faithfulness", c("sample_size") < 1), "sample_size: not positive")
    )


SPEC_SCHEMA = (
    "id string, name string, type string, threshold double, question string, expected_pages array<string>, expected_substrings array<string>, expected_sources array<string>, "
    "recall_floor double, k long, min_recall double, min_precision double, target_file string, sample_size long"
)


def create_tasks(requests: DataFrame, now: str) -> DataFrame:
    """id, brief, status, created_at, updated_at, completed_at, archived_at, workspace_path: a new task for each brief.

    ``requests`` may bring their own ``id``; else each gets a random one.
    """
    own = requests if "id" in requests.columns else requests.withColumn("id", F.uuid())
    none = F.lit(None).cast("string")
    return own.select("id", "brief", F.lit("created").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), none.alias("completed_at"), none.alias("archived_at"), F.concat(F.lit("tasks/tsk-"), "id").alias("workspace_path"))


def load_specs(files: DataFrame) -> DataFrame:
    """path, its spec's columns and error of spec files (path, raw, YAML or JSON objects); one bad file doesn't stop the others."""
    read = files.select("path", yaml_json(F.col("raw")).alias("y"))
    parsed = read.select("path", "y", F.from_json("y.json", SPEC_SCHEMA).alias("s")).select("path", "y", "s.*")
    broken = F.when(F.col("y.error").isNotNull(), F.concat(F.lit("not readable: "), "y.error")).when(~F.coalesce(F.col("y.json").startswith("{"), F.lit(False)), "not an object")
    return parsed.withColumn("error", F.coalesce(broken, F.when(F.col("y.json").startswith("{"), spec_errors(parsed)))).drop("y")


_PARAPHRASES = "array<struct<text:string,primary:boolean>>"


def read_bank(files: DataFrame) -> DataFrame:
    """path, intent_id, question, paraphrases, error of question banks (path, raw, YAML): a row a question, or one for a file that is no bank."""
    schema = f"questions array<struct<id:string,question:string,paraphrases:{_PARAPHRASES}>>"
    read = files.select("path", yaml_json(F.col("raw")).alias("y")).select("path", "y", F.get_json_object("y.json", "$.questions").alias("qs"), F.from_json("y.json", schema).alias("b"))
    error = F.when(F.col("y.error").isNotNull(), F.concat(F.lit("not readable: "), "y.error")).when(F.col("qs").isNull() | ~F.col("qs").startswith("["), "questions: not a list")
    each = read.select("path", error.alias("error"), F.explode_outer(F.when(error.isNull(), F.col("b.questions"))).alias("q"))
    primary = F.transform("q.paraphrases", lambda p: F.struct(p["text"].alias("text"), F.coalesce(p["primary"], F.lit(False)).alias("primary")))
    return each.select("path", F.col("q.id").alias("intent_id"), "q.question", primary.alias("paraphrases"), "error")


def bank_prompts(bank: DataFrame, mode: str = "all") -> DataFrame:
    """intent_id, paraphrase_idx, text, primary of a question bank.

    ``bank`` has intent_id and either question (the first shape) or paraphrases, an array of (text,
    primary); the mode is all or primary.
    """
    if mode not in ("all", "primary"):
        raise ValueError(f"unknown mode {mode!r}")
    one = F.array(F.struct(F.col("question").alias("text"), F.lit(True).alias("primary")))
    each = bank.select("intent_id", F.posexplode(F.coalesce("paraphrases", one)).alias("paraphrase_idx", "p")).select("intent_id", "paraphrase_idx", "p.text", "p.primary")
    return each if mode == "all" else each.filter("primary")


def bank_errors(bank: DataFrame) -> DataFrame:
    """intent_id, error for a bank's entries: both shapes or neither, no or several primaries, empty texts."""
    p = F.col("paraphrases")
    error = (
        F.when(F.col("question").isNotNull() & p.isNotNull(), "two shapes")
        .when(F.col("question").isNull() & (p.isNull() | (F.size(p) == 0)), "no question")
        .when(p.isNotNull() & (F.size(F.filter(p, lambda x: x["primary"])) != 1), "not one primary")
        .when(F.exists(F.coalesce(p, F.array()), lambda x: F.trim(x["text"]) == "") | (F.trim(F.coalesce("question", F.lit("q"))) == ""), "empty text")
    )
    return bank.select("intent_id", error.alias("error"))


def doc_audit(docs: DataFrame) -> DataFrame:
    """path, errors, warnings of documents (path, fields) against what their class of file needs."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.regexp_extract(name, DOC_CLASS, 1)
    lacks = lambda f: F.element_at("fields", f).isNull()
    thesis = (kind == "AT-NTRP") & name.endswith("-thesis.md")
    errors = (
        F.when(_blank(F.element_at("fields", "title")), "title: missing"),
        F.when((kind == "AT-DECR") & lacks("acting_head_of_board"), "acting_head_of_board: missing"),
        F.when((kind == "AT-DECR") & lacks("status"), "status: missing"),
        F.when(thesis & lacks("authors"), "authors: missing"),
    )
    warnings = (*(F.when(lacks(f), f"{f}: recommended") for f in ("filing_code", "date", "status")), F.when(thesis & lacks("cross_repo"), "cross_repo: recommended"))
    return docs.select("path", F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings)).alias("warnings"))


# --- composed files -----------------------------------------------------------------------------


def _quoted(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[([\s\S]*)\]$", 1)


def _sources(pages: Column) -> Column:
    return F.when(F.size(pages) > 0, F.concat(F.lit("source_pages:\n"), F.array_join(F.transform(pages, lambda p: F.concat(F.lit("  - "), p)), "\n"))).otherwise("source_pages: []")


def _tokens(i: Column, o: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(F.lit("input_tokens: "), s(i), F.lit("\noutput_tokens: "), s(o), F.lit("\ntokens_used: "), s(i + o), F.lit("\n"))


def compose_card(card: DataFrame) -> Column:
    """The file of a recall card (topic, concept, generated_at, model, input_tokens, output_tokens, source_pages, question, answer)."""
    c = F.col
    head = F.concat(F.lit("---\ntype: recall-card\ntopic: "), _quoted(c("topic")), F.lit("\nconcept: "), _quoted(c("concept")), F.lit("\ngenerated_at: "), c("generated_at"), F.lit("\nmodel: "), c("model"), F.lit("\n"))
    body = F.concat(F.lit("# "), c("concept"), F.lit("\n\n## Question\n\n"), c("question"), F.lit("\n\n## Answer\n\n"), c("answer"), F.lit("\n"))
    return F.concat(head, _tokens(c("input_tokens"), c("output_tokens")), _sources(c("source_pages")), F.lit("\n---\n"), body)


def compose_quiz(quiz: DataFrame) -> Column:
    """The file of a quiz (topic, generated_at, model, input_tokens, output_tokens, source_pages, items of question, answer, sources)."""
    c = F.col
    head = F.concat(F.lit("---\ntype: recall-quiz\ntopic: "), _quoted(c("topic")), F.lit("\ngenerated_at: "), c("generated_at"), F.lit("\nmodel: "), c("model"), F.lit("\nquestion_count: "), F.size("items").cast("string"), F.lit("\n"))

    def section(q: Column, i: Column) -> Column:
        refs = F.when(F.size(q["sources"]) > 0, F.concat(F.lit("_sources: "), F.array_join(q["sources"], ", "), F.lit("_\n"))).otherwise("")
        return F.concat(F.lit("## Question "), (i + 1).cast("string"), F.lit("\n\n"), q["question"], F.lit("\n\n<details><summary>Answer</summary>\n\n"), q["answer"], F.lit("\n\n"), refs, F.lit("\n</details>\n"))

    body = F.concat(F.lit("# "), c("topic"), F.lit(" — Quiz\n\n"), F.array_join(F.transform("items", section), "\n"))
    return F.concat(head, _tokens(c("input_tokens"), c("output_tokens")), _sources(c("source_pages")), F.lit("\n---\n"), body)


def _number(x: Column) -> Column:
    """A double as JavaScript writes it: whole ones without a point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def bundle_subjects(results: DataFrame, gate: str = "eval:local:") -> DataFrame:
    """id, name, sha256 of evaluation results (id, type, passed, score, threshold): the verdict's digest under a name after ``gate``."""
    clean = F.regexp_replace(F.regexp_replace("id", "[^a-zA-Z0-9.-]", "-"), "^[^a-zA-Z0-9]+", "")
    verdict = F.concat(
        F.lit('{"id":'), _quoted(F.col("id")), F.lit(',"passed":'), F.col("passed").cast("string"), F.lit(',"score":'), _number(F.col("score")), F.lit(',"threshold":'), _number(F.col("threshold")), F.lit(',"type":'), _quoted(F.col("type")), F.lit("}")
    )
    return results.select("id", F.concat(F.lit(gate), F.when(clean == "", "eval").otherwise(clean)).alias("name"), F.sha2(verdict, 256).alias("sha256"))


def bundle_lines(subjects: DataFrame) -> DataFrame:
    """ord, line of the subjects' part of a bundle, keys sorted; lines in order make the file."""
    entry = F.concat(F.lit('{"digest":{"sha256":"'), "sha256", F.lit('"},"name":'), _quoted(F.col("name")), F.lit("}"))
    return subjects.select(F.col("id").alias("ord"), entry.alias("line"))


def spool_manifest(lines: DataFrame) -> DataFrame:
    """category, emitted, bytes, sha256 of each category's spool file: its ``lines`` (category, path, line) by path.

    A file's hash is sequential: its bytes pass through one task.  They come there in order and
    compressed, as sorted ranges that other tasks made, so that task sorts and parses no lines; it
    takes the memory of a range's slice.
    """
    schema = pa.schema([("category", pa.string()), ("emitted", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    packed = pa.schema([("category", pa.string()), ("path", pa.string()), ("emitted", pa.int64()), ("bytes", pa.int64()), ("slice", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, size, at, first = pa.Codec("zstd", 9), [], 0, None, None
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(packed.names, (at, first, len(held), size, codec.compress(b"".join(held), asbytes=True)), strict=True))], schema=packed)
        for batch in batches:
            for category, path, line in zip(*(batch.column(c).to_pylist() for c in ("category", "path", "line")), strict=True):
                if held and (category != at or size >= SLICE_BYTES):
                    yield row()
                    held, size = [], 0
                if not held:
                    at, first = category, path
                held.append(line.encode() + b"\n")
                size += len(held[-1])
        if held:
            yield row()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, at, count, size, digest = pa.Codec("zstd"), None, 0, 0, hashlib.sha256()
        done = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["category"] != at:
                    if count:
                        done.append((at, count, size, digest.hexdigest()))
                    at, count, size, digest = r["category"], 0, 0, hashlib.sha256()
                digest.update(codec.decompress(r["slice"], r["bytes"], asbytes=True))
                count, size = count + r["emitted"], size + r["bytes"]
        if count:
            done.append((at, count, size, digest.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema=schema)

    ranges = lines.select("category", "path", "line").repartitionByRange("category", "path").sortWithinPartitions("category", "path")
    slices = ranges.mapInArrow(pack, "category string, path string, emitted long, bytes long, slice binary")
    return slices.repartition("category").sortWithinPartitions("category", "path").mapInArrow(fold, "category string, emitted long, bytes long, sha256 string")
