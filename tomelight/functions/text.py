"""Scalar text rules as column expressions.

The four slug rules and the front-matter readers differ on purpose: each belongs to another writer
or reader of pages, and results depend on which one is used.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUNCATION_MARKER = "\n\n[...truncated...]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bounded(words: str) -> str:
    """A pattern for ``words`` between characters that are no ASCII word characters."""
    return f"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"


#: White space as ECMAScript's ``\\s`` and ``trim`` have it, for use in a character class.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Letters and digits one by one: in Java a class of single characters is a lookup, while ranges beside others are slow.
_WORDS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: What stands at either side of a word of ASCII word characters.
WORD_START, WORD_END = f"(?<![{_WORDS}_])", f"(?![{_WORDS}_])"
#: A character outside those that are in compatibility composition form whatever stands beside them, which are given one by one too.
_MAY_CHANGE = "[^" + "".join(f"\\x{c:02x}" for c in (*range(0xA0), *range(0xA1, 0xA8), *b"\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb", *range(0xBF, 0x100))) + "]"


def trimmed(text: Column | str) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(_c(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column | str) -> Column:
    """``text`` in Unicode's compatibility composition form; only texts that may change go through Python."""
    text = _c(text)
    return F.coalesce(F.arrow_udf(_composed, "string")(F.when(text.rlike(_MAY_CHANGE), text)), text)


def source_type(path: Column | str) -> Column:
    """The kind of a source file by its last extension."""
    ext = F.regexp_extract(F.lower(_c(path)), r"(\.[^.]*)$", 1)
    return F.when(ext.isin(".md", ".mdx"), "markdown").when(ext == ".pdf", "pdf").when(ext.isin(".html", ".htm"), "html").otherwise("text")


def word_count(text: Column | str) -> Column:
    return F.size(F.array_remove(F.split(_c(text), r"[ \t\n\r\f\x0B]+"), "")).cast("bigint")


def content_hash(text: Column | str) -> Column:
    return F.sha2(F.encode(_c(text), "UTF-8"), 256)


#: The only characters outside ASCII with an ASCII letter in their lower case.
_LOWER_IN_ASCII = (("\u212a", "k"), ("\u0130", "i"))


def _joined(text: Column) -> Column:
    """``text`` in lower case with a hyphen for each run of spaces, underscores and hyphens, other characters dropped.

    They are dropped first, so that what stood at their sides makes one run and only ASCII is left to
    lower; marks that are looked for as they stand need no pattern.
    """
    out = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), _LOWER_IN_ASCII, text)
    out = F.lower(F.regexp_replace(out, rf"[^{_WORDS}_ \t\n\x0B\f\r-]+", ""))
    for mark in "_ \t\n\x0b\f\r":
        out = F.replace(out, F.lit(mark), F.lit("-"))
    return F.regexp_replace(out, "--+", "-")


def _trimmed_slug(text: Column) -> Column:
    return F.btrim(text, F.lit("-"))


def _or(slug: Column, other: str) -> Column:
    return F.when(slug == "", other).otherwise(slug)


def slug_link(text: Column | str) -> Column:
    """Link targets: other characters are dropped, one hyphen at each end goes."""
    return _trimmed_slug(_joined(_c(text)))


def slug_page(text: Column | str) -> Column:
    """Page file names: as for links, and never empty."""
    return _or(slug_link(text), "item")


#: Longest slug of a promoted page.
_TITLE_CHARS = 80


def slug_title(text: Column | str) -> Column:
    """Promoted pages and recall cards: other characters become hyphens, at most 80 characters.

    81 runs of letters and digits make more than those, so what follows them is not looked at.
    """
    start = F.regexp_extract(_c(text), rf"^((?:[^{_WORDS}]*+[{_WORDS}]++){{0,{_TITLE_CHARS + 1}}}[^{_WORDS}]*+)", 1)
    return F.substring(_trimmed_slug(F.regexp_replace(F.lower(start), "[^a-z0-9]+", "-")), 1, _TITLE_CHARS)


def _stem_and_extension(name: Column) -> tuple[Column, Column]:
    """A file name up to its last dot, and from there on; all and nothing if no other character stands before that dot."""
    last = F.substring_index(name, ".", -1)
    stem = name.substr(F.lit(1), F.length(name) - F.length(last) - 1)
    ends = (stem != "") & ~stem.endswith(".")
    return F.when(ends, stem).otherwise(name), F.when(ends, F.concat(F.lit("."), last)).otherwise("")


def slug_file(name: Column | str) -> Column:
    """Raw sources: the extension stays; an empty stem becomes ``source``."""
    stem, ext = _stem_and_extension(_c(name))
    return F.concat(_or(slug_link(stem), "source"), F.lower(ext))


def slugs(names: DataFrame, name: str) -> DataFrame:
    """``names`` with file_slug, page_slug, title_slug and link_slug of the column ``name``, as the four rules have them.

    Stem and extension are joined once each: the whole name's slug is made of theirs, in which two
    hyphens may meet.
    """
    stem, ext = _stem_and_extension(F.col(name))
    parts = names.withColumns({"_stem": stem, "_ext": ext, "title_slug": slug_title(name)})
    parts = parts.withColumns({"_stem": _joined(F.col("_stem")), "_all": _joined(F.col("_ext"))})
    parts = parts.withColumns({"_stem": _trimmed_slug(F.col("_stem")), "link_slug": _trimmed_slug(F.replace(F.concat("_stem", "_all"), F.lit("--"), F.lit("-")))})
    return parts.withColumns({"file_slug": F.concat(_or(F.col("_stem"), "source"), F.lower("_ext")), "page_slug": _or(F.col("link_slug"), "item")}).drop("_stem", "_ext", "_all")


def slug_tag(text: Column | str) -> Column:
    """Tags of exported cards."""
    out = F.regexp_replace(F.lower(_c(text)), r"\.md$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[\s/]+", "-"), "[^a-z0-9_-]", "-")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-+|-+$", "")


def normalize_title(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


#: Fixed value: the namespace of page identifiers.
PAGE_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def _dashes(h: Column) -> Column:
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid5(name: Column | str, namespace: str = PAGE_NAMESPACE) -> Column:
    """The name-based identifier of version 5."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(_c(name), "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return _dashes(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), F.lit("89ab").substr(nibble + 1, F.lit(1)), F.substring(h, 18, 15)))


def uuid7_from(ms: Column | str, seed: Column | str) -> Column:
    """A time-ordered identifier whose other bits come from a hash of ``seed``."""
    h = F.sha2(F.encode(_c(seed), "UTF-8"), 256)
    nibble = F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4
    stamp = F.lower(F.lpad(F.hex(F.greatest(_c(ms).cast("bigint"), F.lit(0).cast("bigint"))), 12, "0"))
    return _dashes(F.concat(stamp, F.lit("7"), F.substring(h, 1, 3), F.lit("89ab").substr(nibble + 1, F.lit(1)), F.substring(h, 5, 3), F.substring(h, 8, 12)))


def estimate_tokens(text: Column | str) -> Column:
    return F.ceil(F.length(_c(text)) / 4).cast("bigint")


def token_budget(batch: Column | str, default: int, explicit: int | None = None) -> Column:
    """The response budget of a batch: what is given, else by batch size between bounds."""
    return F.lit(explicit) if explicit is not None else F.least(F.lit(8000), F.greatest(F.lit(default), _c(batch) * 400))


def excerpt(body: Column | str, most: int) -> Column:
    body = _c(body)
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit(TRUNCATION_MARKER))).otherwise(body)


def xml_escape(text: Column | str) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, _c(text))


def count_slides(text: Column | str) -> Column:
    return (F.regexp_count(F.concat(F.lit("\n"), _c(text)), F.lit(r"\n---[ \t]*(?=\n|$)")) + 1).cast("bigint")


def citation_path(uri: Column | str) -> Column:
    """``qmd://collection/name.md`` as a relative path; null when malformed or climbing out."""
    uri = _c(uri)
    m = r"^qmd://([^/]+)/(.+\.md)$"
    collection = F.regexp_replace(F.regexp_extract(uri, m, 1), "^kb-", "")
    name = F.regexp_extract(uri, m, 2)
    return F.when((name == "") | name.contains(".."), F.lit(None)).otherwise(F.concat_ws("/", collection, name))


# --- front matter -----------------------------------------------------------------------------


def fm_block(page: Column | str) -> Column:
    """Text between the fences at the start of a page, else empty."""
    return F.regexp_extract(_c(page), r"^---[ \t]*\n([\s\S]*?)\n---", 1)


def fm_flat(page: Column | str, opening: str = r"^---[ \t]*\n") -> Column:
    """Key to value by the first colon of each line, the last of equal keys; values stay strings and nothing has no key."""
    block = F.regexp_extract(_c(page), opening + r"([\s\S]*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    pair = F.transform(lines, lambda x: F.struct(trimmed(F.substring_index(x, ":", 1)).alias("k"), trimmed(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keys = F.array_remove(F.array_distinct(F.transform(pair, lambda p: p["k"])), "")
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pair, lambda p: p["k"] == k), -1)["v"]))


def fm_field(page: Column | str, key: str) -> Column:
    """A field anywhere in the text that stands at a line start, unquoted; null without one."""
    found = F.regexp_extract(_c(page), rf"(?m)^{key}:[ \t]*[\"']?([^\n\"']+)[\"']?", 1)
    return F.when(found == "", F.lit(None)).otherwise(F.trim(found))


def fm_list(page: Column | str, key: str) -> Column:
    """A list field of the front matter, inline or in block style; empty without one."""
    block = F.concat(fm_block(page), F.lit("\n"))
    inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    items = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]*[^\n]+\n)+)", 1)
    unquote = lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")
    flow = F.transform(F.split(inline, ","), lambda x: unquote(F.trim(x)))
    lines = F.transform(F.split(items, "\n"), lambda x: unquote(F.trim(F.regexp_replace(x, r"^[ \t]*-[ \t]*", ""))))
    return F.array_remove(F.when(inline != "", flow).otherwise(lines), "")


def fm_body(page: Column | str) -> Column:
    """What follows the front matter, without leading white space."""
    page = _c(page)
    return F.when(page.startswith("---"), F.regexp_replace(F.regexp_replace(page, r"^---[ \t]*\n[\s\S]*?\n---[^\n]*", ""), r"^\s+", "")).otherwise(page)


def fm_set(page: Column | str, key: str, value: Column | str) -> Column:
    """The page with a field set: replaced at its line, else put first in the front matter."""
    page, value = _c(page), value if isinstance(value, Column) else F.lit(value)
    have = page.rlike(rf"(?m)^{key}:")
    before = F.regexp_extract(page, rf"^([\s\S]*?(?:^|\n){key}:[ \t]*)[^\n]*[\s\S]*$", 1)
    after = F.regexp_extract(page, rf"^[\s\S]*?(?:^|\n){key}:[ \t]*[^\n]*([\s\S]*)$", 1)
    return F.when(have, F.concat(before, value, after)).otherwise(
        F.when(page.rlike(r"^---[ \t]*\n"), F.concat(F.lit(f"---\n{key}: "), value, F.lit("\n"), F.regexp_replace(page, r"^---[ \t]*\n", ""))).otherwise(page)
    )


# --- links and citations -----------------------------------------------------------------------


def wikilinks(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def source_citations(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(text), F.lit(rf"\[source:[{SPACE}]*([^\]]+)\]"), F.lit(1)), trimmed)


def llm_json(text: Column | str) -> Column:
    """The JSON object in a model's answer: fences stripped, first brace to last; null without one."""
    found = F.regexp_extract(_c(text), r"(\{[\s\S]*\})", 1)
    return F.when(found == "", F.lit(None)).otherwise(found)


# --- HTML --------------------------------------------------------------------------------------

#: What turns the HTML of a body into Markdown, in order: pattern (in the common syntax) and replacement.
HTML_RULES = (
    (r"<!--[\s\S]*?-->", ""),
    (r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", ""),
    (r"(?is)<pre[^>]*><code[^>]*>(.*?)</code></pre>", "\n\n```\n{1}\n```\n\n"),
    *((rf"(?is)<h{n}[^>]*>\s*(.*?)\s*</h{n}>", "\n\n" + "#" * n + " {1}\n\n") for n in range(1, 7)),
    (r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[{2}]({1})"),
    (r"(?is)<(strong|b)(\s[^>]*)?>\s*(.*?)\s*</(strong|b)>", "**{3}**"),
    (r"(?is)<(em|i)(\s[^>]*)?>\s*(.*?)\s*</(em|i)>", "_{3}_"),
    (r"(?is)<code[^>]*>(.*?)</code>", "`{1}`"),
    (r"(?is)<li[^>]*>\s*(.*?)\s*</li>", "\n*   {1}"),
    (r"(?i)<br[^>]*>", "  \n"),
    (r"(?i)<hr[^>]*>", "\n\n* * *\n\n"),
    (r"(?i)</?(p|div|section|article|nav|header|footer|main|ul|ol|table|tr|blockquote|aside|figure)(\s[^>]*)?>", "\n\n"),
    (r"<[^>]+>", ""),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    (r"\n{3,}", "\n\n"),
    (r"^[ \t\r\n]+|[ \t\r\n]+$", ""),
)


def html_body(html: Column | str) -> Column:
    """What the body element holds, all of it where there is no such element."""
    found = F.regexp_extract(_c(html), r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.when(_c(html).rlike(r"(?is)<body[^>]*>.*</body>"), found).otherwise(_c(html))


def html_markdown(html: Column | str) -> Column:
    """The Markdown of an HTML body: headings, links, emphasis, code, lists and paragraphs; other tags go."""
    out = _c(html)
    for pattern, replacement in HTML_RULES:
        for n in (1, 2, 3):
            replacement = replacement.replace("{%d}" % n, "$%d" % n)
        out = F.regexp_replace(out, pattern, replacement)
    return out
