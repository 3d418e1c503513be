"""HTML bodies as Markdown, by a tree of elements: nested lists, quotes, images, tables' text, code and entities.

``functions.text.html_markdown`` turns flat markup in place; this reads the markup with a stack of
open elements, so that what lies within what decides how it is written.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that have no end, that are dropped with what they hold, that stand in lines of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript head title template".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that the start of another one ends: (opening, ended, up to).
_ENDS = (("li", ("li",), ("ul", "ol")), ("dd", ("dd", "dt"), ("dl",)), ("dt", ("dd", "dt"), ("dl",)), ("tr", ("tr", "td", "th"), ("table",)), ("td", ("td", "th"), ("tr", "table")), ("th", ("td", "th"), ("tr", "table")), ("option", ("option",), ("select",)))
_MARKED = re.compile(r"([\\`*_\[\]])|^(\s*)([-+](?=\s)|#{1,6}(?=\s)|>|=+\s*$|~~~)|^(\s*\d+)\.(?=\s)")


class Element:
    __slots__ = ("children", "name", "attributes")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


class _Tree(HTMLParser):
    """Builds elements from markup; ends that have no start are left out, open elements end with what holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def close_to(self, names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return
            if self.open[k].name in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for opening, ended, until in _ENDS:
            if tag == opening:
                self.close_to(ended, until)
        if tag in BLOCKS:
            self.close_to(("p",), ("blockquote", "li", "td", "th", "div", "section", "article", "button"))
        own = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(own)
        if tag not in VOID:
            self.open.append(own)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if any(e.name == tag for e in self.open[1:]):
            while self.open.pop().name != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Element:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _escaped(text: str) -> str:
    """Characters that Markdown would read as its own, with a backslash."""
    return _MARKED.sub(lambda m: "\\" + m.group(1) if m.group(1) else f"{m.group(2)}\\{m.group(3)}" if m.group(3) else f"{m.group(4)}\\.", text)


def _text(node: Element) -> str:
    return "".join(c if isinstance(c, str) else "" if c.name in DROPPED else "\n" if c.name == "br" else _text(c) for c in node.children)


def _flanked(content: str, mark: str) -> str:
    """``content`` within marks, white space left outside them."""
    body = content.strip()
    return content if not body else content[: len(content) - len(content.lstrip())] + mark + body + mark + content[len(content.rstrip()) :]


class Writer:
    """Writes a tree as Markdown."""

    def blocks(self, node: Element) -> str:
        """What ``node`` holds, as paragraphs and other blocks with a blank line between them."""
        out: list[str] = []
        run: list[str] = []

        def flush() -> None:
            line = re.sub(r"[ \t]*\x00[ \t\n]*", "  \n", re.sub(r"[ \t\n\r\f]+", " ", "".join(run)).strip(" ")).strip("\n")
            line = line.replace("\x01", " ")
            if line.strip():
                out.append("\n".join(x.rstrip() + "  " if k < line.count("\n") else x for k, x in enumerate(line.split("\n"))))
            run.clear()

        for c in node.children:
            if isinstance(c, str):
                run.append(_escaped(c))
            elif c.name in DROPPED:
                continue
            elif c.name in BLOCKS or self.holds_block(c):
                flush()
                if block := self.block(c):
                    out.append(block)
            else:
                run.append(self.inline(c))
        flush()
        return "\n\n".join(out)

    def holds_block(self, node: Element) -> bool:
        return any(not isinstance(c, str) and (c.name in BLOCKS or self.holds_block(c)) for c in node.children)

    def block(self, node: Element) -> str:
        name = node.name
        if re.fullmatch("h[1-6]", name):
            body = " ".join(self.blocks(node).split())
            return f"{'#' * int(name[1])} {body}" if body else ""
        if name == "hr":
            return "* * *"
        if name == "pre":
            code = next((c for c in node.children if not isinstance(c, str) and c.name == "code"), node)
            language = re.search(r"(?:^|\s)language-(\S+)", code.attributes.get("class", ""))
            body = _text(node).removeprefix("\n").rstrip("\n")
            fence = "`" * max(3, 1 + max(map(len, re.findall("^`{3,}", body, re.M)), default=0))
            return f"{fence}{language.group(1) if language else ''}\n{body}\n{fence}"
        if name == "blockquote":
            body = self.blocks(node)
            return "\n".join(f"> {x}".rstrip() for x in body.split("\n")) if body else ""
        if name in ("ul", "ol"):
            return self.listed(node)
        return self.blocks(node)

    def listed(self, node: Element) -> str:
        start = node.attributes.get("start", "")
        n = int(start) if re.fullmatch(r"-?\d+", start) else 1
        out = []
        for c in node.children:
            if isinstance(c, str) and not c.strip() or not isinstance(c, str) and c.name in DROPPED:
                continue
            mark = f"{n}. ".ljust(4) if node.name == "ol" else "*   "
            n += 1
            if isinstance(c, str):
                body = _escaped(" ".join(c.split()))
            elif c.name == "li":
                body = self.item(c)
            else:
                body = self.block(c) if c.name in BLOCKS else self.inline(c)
            out.append(mark.rstrip() if not body else mark + body.replace("\n", "\n" + " " * len(mark)))
        return "\n".join(re.sub(r"(?m)^[ ]+$", "", x) for x in out)

    def item(self, node: Element) -> str:
        """A list's entry; lists right within it follow without a blank line, unless it has paragraphs."""
        loose = any(not isinstance(c, str) and c.name in BLOCKS - {"ul", "ol"} for c in node.children)
        body = self.blocks(node)
        return body if loose else re.sub(r"\n\n(?=(?:\*|\d+\.) )", "\n", body)

    def inline(self, node: Element) -> str:
        name = node.name
        if name == "br":
            return "\x00"
        if name == "img":
            source = node.attributes.get("src", "")
            title = node.attributes.get("title", "")
            alt = " ".join(node.attributes.get("alt", "").split())
            return f"![{alt}]({source}{self.quoted(title)})" if source else ""
        if name in ("code", "kbd", "samp", "tt"):
            body = re.sub(r"\s+", " ", _text(node))
            ticks = "`" * (1 + max(map(len, re.findall("`+", body)), default=0))
            pad = " " if body.startswith("`") or body.endswith("`") else ""
            return f"{ticks}{pad}{body}{pad}{ticks}" if body.strip() else ""
        inner = "".join(_escaped(c) if isinstance(c, str) else "" if c.name in DROPPED else self.inline(c) for c in node.children)
        if name in ("strong", "b"):
            return _flanked(inner, "**")
        if name in ("em", "i"):
            return _flanked(inner, "_")
        if name == "a" and node.attributes.get("href"):
            href = node.attributes["href"].replace("(", r"\(").replace(")", r"\)")
            return f"[{inner.strip()}]({href}{self.quoted(node.attributes.get('title', ''))})" if inner.strip() else ""
        return inner

    @staticmethod
    def quoted(title: str) -> str:
        title = re.sub(r"\n\s*\n", "\n", title).replace('"', r"\"")
        return f' "{title}"' if title else ""


def markdown(html: str) -> str:
    """The Markdown of an HTML body."""
    return Writer().blocks(tree(html)).replace("\xa0", " ").strip()


def ended_references(html: Column) -> Column:
    """HTML whose named character references are those that end with a semicolon; ``&amp`` without one becomes text."""
    return F.regexp_replace(html, "&(?=[a-zA-Z]++(?!;))", "&amp;")


def tree_markdown(html: Column) -> Column:
    """The Markdown of HTML bodies; a null stays null.  A body nested too deeply to be walked is its text alone."""

    def run(bodies: pa.Array) -> pa.Array:
        out = []
        for body in bodies.to_pylist():
            try:
                out.append(None if body is None else markdown(body))
            except RecursionError:
                out.append(" ".join(unescape(re.sub("<[^>]*>", " ", body)).split()))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(html)
