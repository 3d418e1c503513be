"""Deterministic gates: what a model returned, what a text discloses, what may be promoted."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

REFUSAL_CHARS, LEAST_BODY = 300, 20
# Phrases of refusals, disclosures and injections, shapes of secrets, task states.
REFUSALS = r"i\s+cannot|i\s+can['’]t|i\s+am\s+unable|i['’]m\s+unable|i\s+won['’]t|i\s+will\s+not|as\s+an\s+ai|i\s+apologi[sz]e|i['’]m\s+sorry|i\s+am\s+sorry|i\s+don['’]t\s+have\s+(the\s+ability|access)"
#: (words, before, after): whether the phrase begins and ends where a word does; digits and spaces as in patterns.
COMPENSATION = (
    (r"\d{1,3}/\d{1,3}\s*(?:split|share)", True, True), ("7[- ]bucket", True, True), (r"revenue[- ]share\s*\d", False, False), (r"equity\s+(?:stakes?|grants?|granted|options?|\d)", False, False), ("vesting", True, True),
    ("RSUs?", True, True), ("stock options?", False, True), ("strike price", True, True), ("salary", True, True), ("base pay", False, True), ("take[- ]home pay", False, True), (r"(?:launch|signing|sign[- ]on)\s+bonus", False, True),
)
PERSONAL = (
    (r"\d{3}-\d{2}-\d{4}", True, True), ("SSN", True, True), ("social security (?:number|no)", False, True), ("background[- ]check (?:result|report|passed|failed)", False, True),
    ("date of birth", False, True), (r"DOB\s*[:=]", True, False),
)
#: The two characters that each of those begins with, checked before any phrase is tried.
COMPENSATION_STARTS = "(?=[0-9revsbtl][-0-9/ esqtia])(?=[0-9]|r[es]|eq|ve|s[tai]|[btl]a)"
PERSONAL_STARTS = "(?=[0-9sbd][0-9sao])(?=[0-9]|s[so]|ba|d[ao])"
INJECTIONS = (r"ignore\s+(all\s+)?previous\s+instructions", r"ignore\s+the\s+above", r"system\s*prompt", r"you\s+are\s+now", r"disregard\s+(all\s+)?prior")
SECRETS = (r"sk-ant-[A-Za-z0-9_-]+", r"sk-[A-Za-z0-9_-]{20,}", r"Bearer\s+[A-Za-z0-9._-]+")
SECRET_VALUE = r"^(sk-ant-|sk-|Bearer\s)"
SECRET_FIELDS = ("apikey", "api_key", "apiKey", "authorization", "token", "secret", "password", "credential")
TRANSITIONS = {
    "created": ("collecting", "failed_collecting"),
    "collecting": ("synthesizing", "failed_synthesizing"),
    "synthesizing": ("critiquing", "failed_critiquing"),
    "critiquing": ("rendering", "failed_rendering"),
    "rendering": ("completed",),
    "completed": ("archived",),
    "failed_collecting": ("created",),
    "failed_synthesizing": ("collecting",),
    "failed_critiquing": ("synthesizing",),
    "failed_rendering": ("critiquing",),
}
PROMOTION_TYPES = ("topic", "concept", "entity", "reference")
#: Front-matter fields by page type: (field, kind); a kind with a question mark may be missing.
_FILED = (("compiled_at", "time"), ("model", "text"))
PAGE_FIELDS = {
    "source-summary": (("id", "uuid"), ("title", "text"), ("source_id", "uuid"), ("source_path", "text"), *_FILED, ("content_hash", "text"), ("author", "text?"), ("publication_date", "text?"), ("word_count", "count?"), ("key_claims", "list?"), ("tags", "list?")),
    "concept": (("id", "uuid"), ("title", "text"), ("definition", "text"), ("source_ids", "uuids"), *_FILED, ("aliases", "list?"), ("related_concepts", "list?"), ("tags", "list?")),
    "topic": (("id", "uuid"), ("title", "text"), ("source_ids", "uuids"), *_FILED, ("subtopics", "list?"), ("key_findings", "list?"), ("tags", "list?")),
    "entity": (("id", "uuid"), ("title", "text"), ("entity_type", "entity"), ("source_ids", "uuids"), *_FILED, ("aliases", "list?"), ("url", "url?"), ("description", "text?"), ("related_entities", "list?"), ("tags", "list?")),
    "contradiction": (("id", "uuid"), ("title", "text"), ("claim_a", "text"), ("claim_b", "text"), ("source_a_id", "uuid"), ("source_b_id", "uuid"), *_FILED, ("resolution", "text?"), ("severity", "level?"), ("tags", "list?")),
    "open-question": (("id", "uuid"), ("title", "text"), ("question", "text"), *_FILED, ("context", "text?"), ("related_concepts", "list?"), ("suggested_sources", "list?"), ("priority", "level?"), ("tags", "list?")),
}
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: What a value of each kind looks like in front matter; a text is what no other scalar or list is.
FIELD_KINDS = {
    "uuid": f"^{_UUID}$",
    "uuids": rf"^\[ *({_UUID}( *, *{_UUID})*)? *\]$",
    "time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$",
    "count": "^[0-9]+$",
    "list": r"^\[.*\]$",
    "level": "^(low|medium|high)$",
    "entity": "^(person|organization|tool|framework|dataset|other)$",
    "url": "^[a-zA-Z][a-zA-Z0-9+.-]*:[^ ]+$",
}
NOT_TEXT = r"^(true|false|[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|\[.*\])$"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def output_code(content: Column) -> Column:
    """Why a model's output is rejected, null if it is not."""
    t = F.regexp_replace(content, r"^\s+|\s+$", "")
    fenced = t.startswith("---")
    refusal = F.lower(F.substring(t, 1, REFUSAL_CHARS)).rlike(T.bounded(REFUSALS))
    structure = fenced | t.rlike(r"(?m)^[A-Za-z_][A-Za-z0-9_-]*\s*:") | t.rlike(r"(?m)^#{1,6}\s+\S")
    closed = F.regexp_extract(t, r"^---[^\n]*(?:\n[\s\S]*?)?\n---[^\n]*\n([\s\S]*)$", 1)
    body = F.regexp_replace(F.when(fenced, closed).otherwise(t), r"^\s+|\s+$", "")
    return (
        F.when(t == "", "EMPTY_OUTPUT")
        .when(~fenced & refusal, "REFUSAL_DETECTED")
        .when(~structure, "NON_MARKDOWN_JUNK")
        .when(F.length(body) < LEAST_BODY, "BODY_TOO_SHORT")
    )


def _phrases(starts: str, phrases: tuple[tuple[str, bool, bool], ...]) -> str:
    each = (f"{T.WORD_START if before else ''}{words}{T.WORD_END if after else ''}" for words, before, after in phrases)
    return f"(?i){starts}(" + "|".join(each).replace(r"\s", f"[{T.SPACE}]") + ")"


def disclosure(text: Column) -> Column:
    """What a text discloses first: (category, match), null if nothing; compensation wins over personal data.

    The text is taken in its compatibility form, so variants of characters count as what they vary.
    Both kinds are looked for once each, in an array of which the first that is found is taken.
    """
    form = T.nfkc(text)
    kinds = (("comp", COMPENSATION_STARTS, COMPENSATION), ("pii", PERSONAL_STARTS, PERSONAL))
    found = (F.struct(F.lit(name).alias("category"), T.trimmed(F.regexp_extract(form, _phrases(starts, p), 1)).alias("match")) for name, starts, p in kinds)
    return F.get(F.filter(F.array(*found), lambda x: x["match"] != ""), F.lit(0))


def injections(text: Column) -> Column:
    """The numbers of the injection patterns that a text matches."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(i)) for i, p in enumerate(INJECTIONS))))


def redacted(text: Column) -> Column:
    return reduce(lambda out, p: F.regexp_replace(out, p, "[REDACTED]"), SECRETS, text)


class _Number(str):
    """A number as it was written."""


def _redact(value: dict | list) -> dict:
    """As writers of logs redact: a list within a list becomes an object by position."""
    out = {}
    for name, v in value.items() if isinstance(value, dict) else ((str(k), v) for k, v in enumerate(value)):
        if name in SECRET_FIELDS or _is_secret(v):
            out[name] = "[REDACTED]"
        elif isinstance(v, list):
            out[name] = ["[REDACTED]" if _is_secret(x) else _redact(x) if isinstance(x, (dict, list)) else x for x in v]
        else:
            out[name] = _redact(v) if isinstance(v, dict) else v
    return out


def _is_secret(value: object) -> bool:
    return isinstance(value, str) and not isinstance(value, _Number) and re.match(SECRET_VALUE, value) is not None


def _written(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_written(k)}:{_written(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def _redacted_texts(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        try:
            value = None if text is None else json.loads(text, parse_int=_Number, parse_float=_Number)
        except (ValueError, RecursionError):
            value = None
        out.append(_written(_redact(value)) if isinstance(value, dict) else None)
    return pa.array(out, pa.string())


def redacted_json(text: Column) -> Column:
    """JSON objects of any depth with secret names' values and secret values replaced, null for what is no JSON object.

    Objects that hold no such name or value stay as they are; others go through Python and are
    written without spaces, numbers as they were.
    """
    names = "|".join(f'"{n}"' for n in SECRET_FIELDS)
    suspect = text.rlike(f"{names}|sk-|Bearer|\\\\u")
    whole = F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")
    return F.when(whole & suspect, F.arrow_udf(_redacted_texts, "string")(F.when(suspect, text))).when(whole, text)


def redacted_fields(fields: Column) -> Column:
    """A map of strings with secret names and values replaced."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*SECRET_FIELDS) | v.rlike(SECRET_VALUE), "[REDACTED]").otherwise(v))


def task_transitions(events: DataFrame, task: str = "task", order: str = "ord") -> DataFrame:
    """Each state change of a task with whether the change is allowed; the first state has no change."""
    steps = events.withColumn("previous", F.lag("status").over(W.partitionBy(task).orderBy(order))).filter("previous IS NOT NULL")
    ok = _any([(F.col("previous") == a) & F.col("status").isin(*b) for a, b in TRANSITIONS.items()])
    return steps.select(task, order, "previous", "status", ok.alias("valid"))


def promotion_code(path: Column, exists: Column, size: Column, title: Column, kind: Column, confirmed: Column, target_exists: Column) -> Column:
    """The first rule that a promotion breaks, null if none."""
    return (
        F.when(~path.startswith("outputs/"), "INELIGIBLE_PATH")
        .when(path.contains("/tasks/") & path.contains("/drafts/"), "DRAFT_REJECTED")
        .when(path.contains("/tasks/") & path.contains("/evidence/"), "EVIDENCE_REJECTED")
        .when(~exists, "FILE_NOT_FOUND")
        .when(size == 0, "EMPTY_FILE")
        .when(title.isNull() | (F.trim(title) == ""), "MISSING_FRONTMATTER")
        .when(~kind.isin(*PROMOTION_TYPES), "INVALID_TYPE")
        .when(~confirmed, "NOT_CONFIRMED")
        .when(target_exists, "TARGET_EXISTS")
    )


def post_promotion_issues(pages: DataFrame, promotions: DataFrame, files: DataFrame) -> DataFrame:
    """path, issues: the codes that a promoted page (path, source_path, promoted_from, title) breaks."""
    have = files.select(F.col("path").alias("source_path"), F.lit(True).alias("_file")).distinct()
    known = promotions.select(F.col("target_path").alias("path"), F.lit(True).alias("_row")).distinct()
    j = pages.join(have, "source_path", "left").join(known, "path", "left")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    codes = (("PROM001", F.col("_file").isNull()), ("PROM002", blank("promoted_from")), ("PROM003", F.col("_row").isNull()), ("PROM004", blank("title")))
    return j.select("path", F.array_compact(F.array(*(F.when(c, n) for n, c in codes))).alias("issues"))


def field_error(name: str, kind: str, value: Column) -> Column:
    """What is wrong with a front-matter value, null if nothing: required and not there, or not of its kind."""
    shape = kind.rstrip("?")
    fits = ~F.lower(value).rlike(NOT_TEXT) if shape == "text" else value.rlike(FIELD_KINDS[shape])
    missing = value.isNull() | (value == "")
    return (F.when(missing, f"{name}: required") if not kind.endswith("?") else F.when(value.isNull(), F.lit(None).cast("string"))).when(~fits, f"{name}: invalid {shape}")


def schema_errors(kind: Column, fields: Column) -> Column:
    """Messages for the fields, in order, that a page type requires and lacks or that are not of their kind.

    ``fields`` maps names to values as the front matter has them, lists in brackets.  Unknown types
    have a message of their own.
    """
    out = F.array(F.concat(F.lit("type: unknown "), F.coalesce(kind, F.lit("(none)"))))
    for name, own in PAGE_FIELDS.items():
        out = F.when(kind == name, F.array_compact(F.array(*(field_error(f, k, F.element_at(fields, f)) for f, k in own)))).otherwise(out)
    return out


def artifact_errors(df: DataFrame) -> Column:
    """Errors of an artifact's front matter, in field order."""
    c = F.col
    blank = lambda x: F.trim(x) == ""
    checks = (
        F.when(c("type").isNull(), "type: missing").when(~c("type").isin("report", "slides"), "type: invalid"),
        F.when(c("title").isNull(), "title: missing").when(blank(c("title")), "title: empty"),
        F.when(c("generated_at").isNull(), "generated_at: missing").when(blank(c("generated_at")), "generated_at: empty"),
        F.when(c("generated_from").isNull(), "generated_from: missing"),
        F.when(c("model").isNull(), "model: missing").when(blank(c("model")), "model: empty"),
        F.when(c("tokens_used").isNull(), "tokens_used: missing").when(c("tokens_used") != F.floor("tokens_used"), "tokens_used: not an integer"),
        F.when((c("type") == "slides") & ~c("marp"), "marp: required"),
    )
    return F.array_compact(F.array(*checks))


def split_pages(outputs: DataFrame, sentinel: str, mark: str = "---PAGE_BREAK---") -> DataFrame:
    """batch, n, page: outputs without the sentinel, split at page breaks, blank pages dropped."""
    kept = outputs.filter(~F.col("content").contains(sentinel))
    trimmed = F.transform(F.split("content", mark), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return kept.select("batch", F.posexplode(F.array_remove(trimmed, "")).alias("n", "page"))
