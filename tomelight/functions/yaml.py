"""YAML as JSON: the block and flow styles that specs, banks and front matter are written in.

Lines are read once, with the indentation telling what belongs to what.  Anchors, aliases, tags,
complex keys and several documents in one text are errors, as is whatever else cannot be read.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMENT = re.compile(r"(?:^|[ \t])#.*$")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>%@`"'\[\]{},?:-][^#]*?|[?:-][^\s#][^#]*?)\s*:(?=[ \t]|$)""")
_INT, _FLOAT = re.compile(r"[-+]?[0-9]+"), re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?")
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
# What escapes in double quotes stand for.
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


class YamlError(ValueError):
    """What cannot be read, with the line's number."""


def scalar(text: str) -> object:
    """A plain scalar as null, a boolean, a number or a string."""
    if text in _WORDS:
        return _WORDS[text]
    if _INT.fullmatch(text):
        return int(text)
    if re.fullmatch(r"0x[0-9a-fA-F]+|0o[0-7]+", text):
        return int(text, 0)
    if _FLOAT.fullmatch(text):
        return float(text)
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", text):
        return None  # JSON has no such numbers
    return text


def _double(body: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "xuU":
            return chr(int(x[1:], 16))
        if x not in _ESCAPES:
            raise YamlError(f"unknown escape \\{x}")
        return _ESCAPES[x]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, body, flags=re.S)


def _folded(text: str) -> str:
    """Line ends within a quoted or plain scalar: one is a space, each further one a line end."""
    return re.sub(r"[ \t]*\n[ \t]*((?:\n[ \t]*)*)", lambda m: "\n" * m.group(1).count("\n") or " ", text)


class _Flow:
    """Reads one value in flow style."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> None:
        m = re.compile(r"(?:\s|(?:(?<=\s)|^)#[^\n]*)*").match(self.text, self.at)
        self.at = m.end()

    def value(self, inside: bool) -> object:
        self.skip()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            return self.items("]", lambda: self.entry())
        if c == "{":
            pairs: dict = {}
            self.items("}", lambda: pairs.update([self.pair()]))
            return pairs
        if c in ('"', "'"):
            return self.quoted()
        if c and c in "&*!|>%@`":
            raise YamlError(f"{c} is not supported here")
        m = re.compile(r"(?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|$)|(?<!\s)#|\n)+" if inside else r"(?:.|\n)+").match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return scalar(_folded(m.group().strip()))

    def quoted(self) -> str:
        rx = r'"((?:[^"\\]|\\[\s\S])*)"' if self.text[self.at] == '"' else r"'((?:[^']|'')*)'"
        m = re.compile(rx).match(self.text, self.at)
        if not m:
            raise YamlError("a quote is not closed")
        self.at = m.end()
        return _double(re.sub(r"\\\n[ \t]*", "", _folded(m.group(1)) if "\\\n" not in m.group(1) else m.group(1))) if m.group()[0] == '"' else _folded(m.group(1)).replace("''", "'")

    def items(self, closing: str, one) -> list:
        self.at += 1
        out = []
        while True:
            self.skip()
            if self.text.startswith(closing, self.at):
                self.at += 1
                return out
            if self.at >= len(self.text):
                raise YamlError(f"{closing} is missing")
            out.append(one())
            self.skip()
            if self.text.startswith(",", self.at):
                self.at += 1
            elif not self.text.startswith(closing, self.at):
                raise YamlError(f"a comma or {closing} is missing")

    def entry(self) -> object:
        value = self.value(True)
        self.skip()
        if self.text.startswith(":", self.at):
            self.at += 1
            return {_name(value): self.value(True)}
        return value

    def pair(self) -> tuple[str, object]:
        name = self.value(True)
        self.skip()
        if self.text.startswith(":", self.at):
            self.at += 1
            return _name(name), self.value(True)
        return _name(name), None


def _name(value: object) -> str:
    if isinstance(value, (dict, list)):
        raise YamlError("a key must be a scalar")
    return value if isinstance(value, str) else json.dumps(value)


class _Lines:
    """Reads the lines of a document; ``nodes`` by indentation."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.at = 0

    def fail(self, what: str):
        raise YamlError(f"line {self.at + 1}: {what}")

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line with content."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            if body.strip() and not body.startswith("#"):
                if body.startswith("\t"):
                    self.fail("a tab indents")
                return len(line) - len(body), body
            self.at += 1
        return None

    def node(self, least: int) -> object:
        seen = self.peek()
        if seen is None or seen[0] < least:
            return None
        indent, body = seen
        if re.match(r"-(?:[ \t]|$)", body):
            return self.sequence(indent)
        if _KEY.match(body):
            return self.mapping(indent)
        return self.inline(body, indent, least)

    def sequence(self, indent: int) -> list:
        out = []
        while (seen := self.peek()) and seen[0] == indent and re.match(r"-(?:[ \t]|$)", seen[1]):
            rest = seen[1][1:].lstrip(" \t")
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1))
            elif re.match(r"-(?:[ \t]|$)", rest) or _KEY.match(rest):
                inner = len(seen[1]) - len(rest) + indent
                self.lines[self.at] = " " * inner + rest  # what follows the dash is a node of its own
                out.append(self.node(inner))
            else:
                out.append(self.inline(rest, indent, indent + 1))
        if (seen := self.peek()) and seen[0] > indent:
            self.fail("bad indentation of an entry")
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (seen := self.peek()) and seen[0] == indent:
            m = _KEY.match(seen[1])
            if not m or re.match(r"-(?:[ \t]|$)", seen[1]):
                self.fail("a key is missing")
            flow = _Flow(m.group(1))
            name = _name(flow.quoted() if m.group(1)[0] in "\"'" else scalar(m.group(1)))
            if name in out:
                self.fail(f"duplicated key {name}")
            rest = seen[1][m.end() :].lstrip(" \t")
            if not rest or rest.startswith("#"):
                self.at += 1
                below = self.peek()
                out[name] = self.sequence(indent) if below and below[0] == indent and re.match(r"-(?:[ \t]|$)", below[1]) else self.node(indent + 1)
            else:
                out[name] = self.inline(rest, indent, indent + 1)
        if (seen := self.peek()) and seen[0] > indent:
            self.fail("bad indentation of a key")
        return out

    def inline(self, rest: str, indent: int, least: int) -> object:
        """A value that starts on the present line and may go on below, indented by ``least`` or more."""
        if rest[0] in "|>":
            return self.block(rest, indent)
        if rest[0] in "&*!%@`":
            self.fail(f"{rest[0]} is not supported")
        if rest[0] in "[{\"'":
            text, first = rest, self.at
            while True:
                flow = _Flow(text)
                try:
                    value = flow.value(False)
                    break
                except YamlError as e:
                    self.at += 1
                    below = self.lines[self.at] if self.at < len(self.lines) else None
                    if below is None or (below.strip() and len(below) - len(below.lstrip(" ")) < least):
                        self.at = first
                        self.fail(str(e))
                    text += "\n" + below
            flow.skip()
            tail = text[flow.at :]
            if tail.strip() and not re.match(r"\s+#", text[flow.at :]):
                self.fail("text after a value")
            self.at += 1
            return value
        parts = [_COMMENT.sub("", rest).strip()]
        ended = parts[0] != rest.strip()
        if re.search(r":(?:[ \t]|$)", parts[0]):
            self.fail("a mapping within a scalar")
        self.at += 1
        blank = 0
        while not ended and self.at < len(self.lines):
            line = self.lines[self.at]
            if not line.strip():
                blank += 1
            elif len(line) - len(line.lstrip(" ")) < least or line.lstrip().startswith("#"):
                break
            else:
                body = _COMMENT.sub("", line).strip()
                if re.search(r":(?:[ \t]|$)", body):
                    self.fail("a mapping within a scalar")
                parts.append("\n" * blank + body if blank else body)
                ended, blank = body != line.strip(), 0
            self.at += 1
        out = parts[0]
        for p in parts[1:]:
            out += p if p.startswith("\n") else " " + p
        return scalar(out)

    def block(self, rest: str, indent: int) -> str:
        m = re.fullmatch(r"([|>])([-+]?)([1-9]?)([-+]?)(?:[ \t]+#.*|[ \t]*)", rest)
        if not m:
            self.fail("bad block scalar")
        chomp, folded = m.group(2) or m.group(4), m.group(1) == ">"
        self.at += 1
        own, depth = [], indent + int(m.group(3)) if m.group(3) else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip(" "):
                here = len(line) - len(line.lstrip(" "))
                depth = here if depth is None else depth
                if here < depth or here <= indent and (depth <= indent):
                    break
            own.append(line)
            self.at += 1
        body = [x[depth or 0 :] for x in own]
        last = max((k for k, x in enumerate(body) if x.strip(" ")), default=-1)
        ends = len(body) - last - 1 - (1 if self.at == len(self.lines) and body and body[-1] == "" else 0)
        text, pending = "", 0
        for k, x in enumerate(body[: last + 1]):
            if not folded or k == 0:
                text += ("\n" if k else "") + x
            elif not x:
                pending += 1
            else:
                near = body[k - 1 - pending]
                more = x[0] in " \t" or near[:1] in (" ", "\t")
                text += "\n" * (pending + 1) if more or not near else "\n" * pending if pending else " "
                text, pending = text + x, 0
        return text if chomp == "-" or last < 0 and chomp != "+" else text + "\n" + ("\n" * max(ends, 0) if chomp == "+" else "")


def load(text: str) -> object:
    """The value of a YAML document; YamlError if it cannot be read."""
    lines = _Lines(text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
    if (seen := lines.peek()) and re.match(r"---(?:\s|$)", seen[1]) and seen[0] == 0:
        rest = seen[1][3:].strip()
        if rest and not rest.startswith("#"):
            lines.lines[lines.at] = "    " + rest
        else:
            lines.at += 1
    for k in range(lines.at, len(lines.lines)):
        if re.match(r"(---|\.\.\.)(?:\s|$)", lines.lines[k]):
            if any(x.strip() and not x.lstrip().startswith("#") for x in lines.lines[k + 1 :]) or lines.lines[k].startswith("---"):
                lines.at = k
                lines.fail("several documents")
            lines.lines = lines.lines[:k]
            break
    value = lines.node(0)
    if lines.peek():
        lines.fail("text after the document")
    return value


def _plain(value: object) -> object:
    """``value`` with numbers that JSON and its readers can hold."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        return None if not math.isfinite(value) else int(value) if value.is_integer() and abs(value) < 1 << 53 else value
    return value


def yaml_json(text: Column) -> Column:
    """(json, error) of YAML texts: the value as JSON, or why it cannot be read; nulls stay null."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append(None if text is None else {"json": json.dumps(_plain(load(text)), ensure_ascii=False), "error": None})
            except (ValueError, RecursionError, OverflowError) as e:
                out.append({"json": None, "error": str(e) or type(e).__name__})
        return pa.array(out, pa.struct([("json", pa.string()), ("error", pa.string())]))

    return F.arrow_udf(run, "struct<json:string,error:string>")(text)
