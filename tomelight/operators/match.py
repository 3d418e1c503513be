"""Phrases, boolean expressions and snippets over a stored index.

An expression becomes one filter over a page's postings: the postings of its terms are read, gathered
by page, and each phrase's places are found by intersecting the places of its terms, moved by their
distance.  Page texts are read for the snippets of what was found only.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search as S

NEAR_TERMS = 10
SNIPPET_TERMS = 32
#: What a snippet's window gains for a phrase it has first and again, and for starting a text or a sentence.
FIRST_SEEN, SEEN_AGAIN, TEXT_START, SENTENCE_START = 1000, 1, 120, 100

_PART = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|(?P<mark>[(){}:+*^,-]))')


@dataclass(frozen=True)
class Phrase:
    """Terms in a row; the last may be a prefix; ``initial``: at the start of a column; ``columns``: numbers, all if None."""

    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: frozenset[int] | None = None


@dataclass(frozen=True)
class Group:
    """``kind`` and, or, not, or near (of phrases, with at most ``within`` terms between)."""

    kind: str
    parts: tuple
    within: int = 0


class _Reader:
    """Reads an expression: implicit and, NOT, AND, OR, from the closest binding to the loosest."""

    def __init__(self, text: str, index: S.Index):
        self.index, self.parts, at = index, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"expression: syntax error near {text[at:at + 10]!r}")
            self.parts.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def see(self, value: str | None = None, ahead: int = 0) -> bool:
        part = self.parts[self.at + ahead] if self.at + ahead < len(self.parts) else (None, None)
        return part[0] is not None if value is None else part[1] == value and part[0] != "string"

    def take(self, value: str | None = None) -> tuple[str, str]:
        if not self.see(value):
            near = self.parts[self.at][1] if self.see() else "the end"
            raise ValueError(f"expression: syntax error near {near!r}")
        self.at += 1
        return self.parts[self.at - 1]

    def whole(self):
        out = self.either()
        if self.see():
            self.take("")
        return out

    def chain(self, word: str, kind: str, below):
        out = below()
        while self.see(word):
            self.take()
            out = _join(kind, out, below())
        return out

    def either(self):
        return self.chain("OR", "or", lambda: self.chain("AND", "and", lambda: self.chain("NOT", "not", self.row)))

    def row(self):
        out = self.unit()
        while self.see() and not any(self.see(x) for x in (")", "AND", "OR", "NOT", ",", "}")):
            out = _join("and", out, self.unit())
        return out

    def columns(self) -> frozenset[int] | None:
        """The columns before a colon, if that is what stands here."""
        start, minus = self.at, self.see("-")
        self.at += minus
        names = []
        if self.see("{"):
            self.take()
            while not self.see("}"):
                names.append(self.take()[1])
            self.take()
        elif self.see() and self.parts[self.at][0] != "mark":
            names.append(self.take()[1])
        if not names or not self.see(":"):
            if minus:
                self.take("")
            self.at = start
            return None
        self.take()
        known = {c.lower(): k for k, c in enumerate(self.index.columns)}
        numbers = []
        for name in (n.strip('"').lower() for n in names):
            if name not in known:
                raise ValueError(f"expression: no such column: {name}")
            numbers.append(known[name])
        return frozenset(set(known.values()) - set(numbers)) if minus else frozenset(numbers)

    def unit(self):
        own = self.columns()
        if self.see("("):
            self.take()
            out = self.either()
            self.take(")")
        elif self.see("NEAR") and self.see("(", 1):
            self.at += 2
            phrases, within = [], NEAR_TERMS
            while not self.see(")"):
                if self.see(","):
                    self.take()
                    kind, value = self.take()
                    if kind != "word" or not value.isdigit():
                        raise ValueError(f"expression: expected a number, got {value!r}")
                    within = int(value)
                    break
                phrases.append(self.phrase())
            self.take(")")
            phrases = [p for p in phrases if p]
            out = Group("near", tuple(phrases), within) if len(phrases) > 1 else phrases[0] if phrases else None
        else:
            out = self.phrase()
        return out if own is None else _within(out, own)

    def phrase(self) -> Phrase | None:
        initial = self.see("^")
        self.at += initial
        terms: list[str] = []
        while True:
            kind, value = self.take()
            if kind == "mark" or kind == "word" and value in ("AND", "OR", "NOT"):
                self.at -= 1
                self.take("")
            text = value[1:-1].replace('""', '"') if kind == "string" else value
            terms += S.terms_of(text, self.index.stem, self.index.stem)
            if not self.see("+"):
                break
            self.take()
        prefix = self.see("*")
        self.at += prefix
        return Phrase(tuple(terms), prefix, initial) if terms else None


def _join(kind: str, left, right):
    """Both sides; one that has no terms is left out."""
    return right if left is None else left if right is None else Group(kind, (left, right))


def _within(node, columns: frozenset[int]):
    """``node`` for the given columns only, besides limits of its own."""
    if node is None:
        return None
    if isinstance(node, Phrase):
        return replace(node, columns=columns if node.columns is None else node.columns & columns)
    return replace(node, parts=tuple(_within(p, columns) for p in node.parts))


def parse(expression: str, index: S.Index):
    """The tree of an expression, with its terms as ``index`` has them; None if it has no terms.  Raises ValueError."""
    if not expression.strip():
        return None
    return _Reader(expression, index).whole()


def phrases_of(node) -> list[Phrase]:
    return [] if node is None else [node] if isinstance(node, Phrase) else [p for part in node.parts for p in phrases_of(part)]


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _starts(phrase: Phrase, places: Column) -> Column:
    """Where ``phrase`` starts, ascending; ``places`` maps the page's terms to theirs."""
    none = F.array().cast("array<bigint>")

    def of(k: int, term: str) -> Column:
        if k == len(phrase.terms) - 1 and phrase.prefix:
            return F.flatten(F.transform(F.filter(F.map_entries(places), lambda e: e["key"].startswith(term)), lambda e: e["value"]))
        return F.coalesce(F.element_at(places, F.lit(term)), none)

    out = reduce(F.array_intersect, [_moved(of(k, t), k) for k, t in enumerate(phrase.terms)])
    if phrase.columns is not None:
        out = F.filter(out, lambda p: F.floor(p / S.COLUMN_PLACES).isin(*phrase.columns)) if phrase.columns else none
    if phrase.initial:
        out = F.filter(out, lambda p: p % S.COLUMN_PLACES == 0)
    return F.array_sort(out)


def clumps(starts: list[list[int]], reach: list[int]) -> list[list[int]]:
    """Of each phrase the ascending starts that lie in a clump of all phrases, reckoned back from the clump's last start."""

    def last(own: list[int], end: int) -> int:
        at = bisect_right(own, end)
        return own[at - 1] if at else -1 - max(reach) - S.COLUMN_PLACES

    ends = [e for e in sorted({p for own in starts for p in own}) if all(last(own, e) + r >= e for own, r in zip(starts, reach, strict=True))]

    def held(x: int, r: int) -> bool:
        at = bisect_left(ends, x)
        return at < len(ends) and ends[at] <= x + r

    return [[x for x in own if held(x, r)] for own, r in zip(starts, reach, strict=True)]


def _near(starts: list[Column], phrases: list[Phrase], within: int) -> list[Column]:
    reach = [len(p.terms) + within for p in phrases]

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([clumps(list(row), reach) for row in rows], pa.list_(pa.list_(pa.int64())))

    both = F.arrow_udf(run, "array<array<bigint>>")(*starts)
    return [F.get(both, F.lit(k)) for k in range(len(starts))]


def _condition(node, starts: Iterator[Column]) -> Column:
    """Whether a page fits; takes one of ``starts`` for each phrase, in order."""
    if isinstance(node, Phrase):
        return F.size(next(starts)) > 0
    parts = [_condition(p, starts) for p in node.parts]
    if node.kind == "not":
        return parts[0] & ~parts[1]
    return reduce((lambda a, b: a | b) if node.kind == "or" else (lambda a, b: a & b), parts)


def _clumped(node, starts: list[Column]) -> list[Column]:
    """``starts`` with those of near groups kept to their clumps."""
    if isinstance(node, Phrase):
        return [starts.pop(0)]
    if node.kind == "near":
        return _near([starts.pop(0) for _ in node.parts], list(node.parts), node.within)
    return [c for part in node.parts for c in _clumped(part, starts)]


def _with_prefixes(index: S.Index, phrases: list[Phrase]) -> DataFrame:
    """term of all terms that the phrases name; prefixes are ranges of the sorted term lists."""
    spark = index.terms.sparkSession
    whole = {t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)}
    out = spark.createDataFrame([(t,) for t in sorted(whole)], "term string")
    starts = sorted({p.terms[-1] for p in phrases if p.prefix})
    if starts:
        out = out.unionByName(index.terms.filter(reduce(lambda a, b: a | b, (F.col("term").startswith(s) for s in starts))).select("term"))
    return out.distinct()


def match_pages(index: S.Index, expression: str) -> DataFrame:
    """key, rank, starts of the pages that fit ``expression``; lower ranks are better.

    An expression has words, "phrases", ``pre*``, ``^first``, ``a + b``, AND, OR, NOT, NEAR(a b, n),
    parentheses and columns (``title : x``, ``{title tags} : x``, ``- body : x``); words side by side
    must all match.  ``starts`` has the places of each phrase in turn.  A phrase weighs like a term:
    by how many pages have it and how often.  ValueError tells what cannot be read; an expression
    without terms finds nothing.
    """
    key, node = index.key, parse(expression, index)
    phrases = phrases_of(node)
    if not phrases:
        return index.postings.select(key, F.lit(0.0).alias("rank"), F.lit(None).cast("array<array<bigint>>").alias("starts")).limit(0)
    own = S.of_terms(index.postings, _with_prefixes(index, phrases), index.buckets).select(key, "term", "doc_len", S.placed("gaps").alias("places"))
    # A page has a row a term of the expression.
    gathered = own.groupBy(key).agg(F.first("doc_len").alias("doc_len"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("places"))
    plain = gathered.select(key, "doc_len", *(_starts(p, F.col("places")).alias(f"_{k}") for k, p in enumerate(phrases)))
    names = [f"_{k}" for k in range(len(phrases))]
    kept = plain.select(key, "doc_len", *(c.alias(n) for n, c in zip(names, _clumped(node, [F.col(n) for n in names]), strict=True)))
    counts = kept.agg(*(F.count_if(F.size(n) > 0).alias(f"df{n}") for n in names))
    k1, b = S.K1, S.B

    def weight(n: str) -> Column:
        idf = F.log((F.col("n") - F.col(f"df{n}") + 0.5) / (F.col(f"df{n}") + 0.5))
        tf = F.size(n)
        return F.when(tf > 0, F.when(idf <= 0, S.LEAST_IDF).otherwise(idf) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len"))))).otherwise(0.0)

    fits = kept.filter(_condition(node, iter([F.col(n) for n in names])))
    weighed = fits.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(index.totals))
    return weighed.select(key, (-reduce(lambda x, y: x + y, map(weight, names))).alias("rank"), F.array(*names).alias("starts"))


def phrase_hits(index: S.Index, phrases: DataFrame) -> DataFrame:
    """id, key, hits: how often each page has each of many phrases (id, terms), in any one column.

    Only pages with a phrase's rarest term can have it: places of the other terms are met on those.
    A phrase with a term that no page has is nowhere.  No page text is read.
    """
    key = index.key
    wanted = phrases.select("id", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term"))
    known = wanted.join(S.of_terms(index.terms, wanted, index.buckets).select("term", "df"), "term")
    rarest = known.groupBy("id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("have"), F.min_by("term", F.struct("df", "term")).alias("term")).filter("have = n").select("id", "term")
    pages = rarest.join(S.of_terms(index.postings, rarest, index.buckets).select(key, "term"), "term").select("id", key)
    own = S.of_terms(index.postings, wanted, index.buckets).select(key, "term", "gaps")
    met = pages.join(wanted, "id").join(own, [key, "term"]).select("id", key, "n", "at", S.placed("gaps").alias("places"))
    moved = met.select("id", key, "n", F.transform("places", lambda p: p - F.col("at")).alias("places"))
    shared = moved.groupBy("id", key).agg(F.first("n").alias("n"), F.collect_list("places").alias("all"))
    both = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), F.array_intersect)
    return shared.filter(F.size("all") == F.col("n")).select("id", key, F.size(both).cast("long").alias("hits")).filter("hits > 0")


# --- snippets ----------------------------------------------------------------------------------


def spans(text: str, fold: bool) -> list[tuple[int, int]]:
    """Where each term of ``text`` starts and ends."""
    if not fold:
        return [m.span() for m in re.finditer("[a-z0-9]+", text.lower())]
    letter = [unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" for c in text]
    out, at = [], 0
    while at < len(text):
        if letter[at]:
            end = at + 1
            while end < len(text) and (letter[end] or unicodedata.category(text[end])[0] == "M"):
                end += 1
            out.append((at, end))
            at = end
        at += 1
    return out


def best_window(n_terms: int, found: list[tuple[int, int, int]], sentences: list[int], size: int = SNIPPET_TERMS) -> int:
    """The first term of the window of ``size`` terms to show.

    ``found`` has (start, length, phrase) of what matched, ascending; a window is tried from each of
    these, moved so that what it holds is in its middle, and from the sentence before.
    """

    def score(at: int) -> tuple[int, int]:
        seen: set[int] = set()
        points, first, last = 0, -1, -1
        for start, length, phrase in found:
            if at <= start < at + size:
                points += SEEN_AGAIN if phrase in seen else FIRST_SEEN
                seen.add(phrase)
                first = start if first < 0 else first
                last = start + length
        moved = first - (size - (last - first)) // 2 if size >= last - first else first + -(-(last - first - size) // 2)
        return points, max(0, min(moved, n_terms - size))

    best, at = 0, 0
    for start, _, _ in found:
        points, moved = score(start)
        if points > best:
            best, at = points, moved
        if sentences and n_terms > size:
            before = max((s for s in sentences if s <= start), default=sentences[0])
            if before < start:
                points = score(before)[0] + (SENTENCE_START if before else TEXT_START)
                if points > best:
                    best, at = points, before
    return at


def snippet_of(text: str, found: list[tuple[int, int, int]], fold: bool, opening: str, closing: str, gap: str, size: int) -> str:
    """The best window of ``text`` with what matched marked; all of it if it has no more terms than that."""
    where = spans(text, fold)
    sentences = [0] if where else []
    for k, (start, _) in enumerate(where[1:], 1):
        before = text[:start].rstrip(" \t\n\r") if text[start - 1] in " \t\n\r" else ""
        if before.endswith((".", ":")):
            sentences.append(k)
    at = best_window(len(where), found, sentences, size)
    until = min(at + size, len(where))
    marked: list[tuple[int, int]] = []
    for start, length, _ in found:
        if at <= start and start + length <= until:
            if marked and start < marked[-1][1]:
                marked[-1] = (marked[-1][0], max(marked[-1][1], start + length))
            else:
                marked.append((start, start + length))
    begin, end = (where[at][0] if at else 0), (where[until - 1][1] if until < len(where) else len(text))
    out, last = [gap if at else ""], begin
    for a, b in marked:
        out += [text[last : where[a][0]], opening, text[where[a][0] : where[b - 1][1]], closing]
        last = where[b - 1][1]
    return "".join([*out, text[last:end], gap if until < len(where) else ""])


def snippets(index: S.Index, expression: str, found: DataFrame, column: str = "body", opening: str = "<b>", closing: str = "</b>", gap: str = "...", size: int = SNIPPET_TERMS) -> DataFrame:
    """``found`` (of ``match_pages``, with a limit) and the stored columns of its pages, with ``snippet`` from ``column``."""
    number, lengths, fold = index.columns.index(column), [len(p.terms) for p in phrases_of(parse(expression, index))], index.stem
    low, high = number * S.COLUMN_PLACES, (number + 1) * S.COLUMN_PLACES

    def shown(texts: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for text, each in zip(texts.to_pylist(), starts.to_pylist(), strict=True):
            hits = sorted((p - low, lengths[k], k) for k, own in enumerate(each) for p in own if low <= p < high)
            out.append(snippet_of(text or "", hits, fold, opening, closing, gap, size))
        return pa.array(out, pa.string())

    return S.stored_pages(index, found).withColumn("snippet", F.arrow_udf(shown, "string")(column, "starts"))


def search_expression(index: S.Index, expression: str, limit: int = 20, **kw) -> DataFrame:
    """The best ``limit`` pages for an expression, ties by key, with snippets."""
    found = match_pages(index, expression).orderBy(F.round("rank", 9), index.key).limit(limit)
    return snippets(index, expression, found, **kw)
