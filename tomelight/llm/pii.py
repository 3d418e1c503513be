"""Personal data in texts.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for account
numbers) and words nearby move a proposal's score.  Four base kinds are always kept once their own
rule confirms them; the further kinds are kept from ``MIN_SCORE`` up.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import fill_cores
from .common import id_and_text, map_all_columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "local_phone", "national_id")
MIN_SCORE = 0.6
#: Characters on each side of a proposal in which context words count.
CONTEXT_CHARS = 48

# Prior scores, and the words that raise them.
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.75, "iban": 0.9, "short_card": 0.35, "local_phone": 0.3, "national_id": 0.4}
_CONTEXT = {
    "email": r"e-?mail|contact|correo|courriel",
    "ip": r"ip|address|host|server|adresse",
    "card": r"card|visa|mastercard|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|telefon|t[eé]l[eé]fono|t[eé]l[eé]phone",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "short_card": r"card|visa|amex|american express|diners|credit|debit|karte|carte|tarjeta",
    "local_phone": r"phone|tel|call|mobile|fax|telefon|t[eé]l[eé]fono|t[eé]l[eé]phone",
    "national_id": r"ssn|social security|national id|tax id",
}
_CONTEXT_RX = {k: re.compile(rf"(?<![^\W\d_])(?:{v})(?![^\W\d_])", re.I) for k, v in _CONTEXT.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive quantifiers: none of these patterns can gain from giving characters back, and so each
# stays linear on hostile input.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

_SINGLES = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", m.end() if m else at + 1)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") < 3:
            continue
        parts, at = chain.split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, end
            at = end + 1


def _digit_runs(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            yield m.start(), m.end(), m.group().translate(_SINGLES)


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(m.group().translate(_SINGLES)) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for head in _IBAN_HEAD.finditer(text):
        m = _IBAN.match(text, head.start()) if head.start() >= done else None
        if not m:
            continue
        end = m.end()
        if text[end : end + 1].isascii() and text[end : end + 1].isalnum():  # cut at the most characters, inside a word
            end = text.rfind(" ", m.start(), end)
        while end >= 0:  # words in capitals or further numbers may follow an account number
            account = text[m.start() : end].replace(" ", "")
            if len(account) < 15:
                break
            if mod97(account):
                done = end
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]
    return min(1.0, _PRIOR[kind] + (0.35 if _CONTEXT_RX[kind].search(near) else 0.0))


def _united(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends, in order, of what the spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _overlaps(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    k = bisect_right(ends, start)
    return k < len(starts) and starts[k] < end


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in ``KINDS``, then start; code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    found["ip"] = list(_ips(text))
    for start, end, digits in _digit_runs(text):
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append((start, end))
        elif 13 <= len(digits) <= 15 and luhn(digits):
            found["short_card"].append((start, end))
    if "+" in text:
        found["phone"] = list(_phones(text))
    found["iban"] = list(_ibans(text))
    found["local_phone"] = [m.span() for m in _LOCAL_PHONE.finditer(text)]
    found["national_id"] = [m.span() for m in _NATIONAL_ID.finditer(text)]
    starts, ends = _united([s for k in BASE_KINDS for s in found[k]])
    out = []
    for kind in KINDS:
        for start, end in found[kind]:
            if kind in BASE_KINDS:
                out.append((kind, start, end, score(text, kind, start, end)))
            elif (s := score(text, kind, start, end)) >= MIN_SCORE and not _overlaps(starts, ends, start, end):
                out.append((kind, start, end, s))
    return out


def redact_text(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans make one."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_FOUND = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>, redacted string"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _find(redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for text in batch.column("text"):
                text = text.as_py()
                spans.append(find_spans(text))
                texts.append(redact_text(text, spans[-1]) if redact and spans[-1] else text if redact else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in x] for x in spans], _SPAN), pa.array(texts, pa.string())],
                names=["doc_id", "spans", "redacted"],
            )

    return run


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, spans with their scores and, if asked, the redacted text.

    A null text counts as empty; an empty one has no spans.  Repeated rows each give a row.  An
    empty input gives no rows.  Further columns play no part.
    """
    return fill_cores(id_and_text(df, id_col, text_col)).mapInArrow(_find(redact), _FOUND)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE_KINDS]
        base, full = [], []
        for text in batch.column("text"):
            spans = find_spans(text.as_py())
            for k, kind in enumerate(BASE_KINDS):
                counts[k].append(sum(s[0] == kind for s in spans))
            base.append(hashlib.sha256(",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans if s[0] in BASE_KINDS).encode()).hexdigest())
            full.append(",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(full, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
        )


def personal_data_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find_personal_data`` as counts, a digest of the base spans and all spans in one string.

    A null text counts as empty and has none.  Repeated rows each give a row, an empty input none;
    further columns play no part.
    """
    return fill_cores(id_and_text(df, id_col, text_col)).mapInArrow(
        _digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced; its columns, order and rows stay.

    A null text becomes the empty one.  ``n_chars``, where there is such a column of integers, follows
    the text.  Repeated rows stay; an empty table gives an empty one.  Other columns may have any
    names and types.
    """
    sizes = [k for k, (name, kind) in enumerate(df.dtypes) if name == "n_chars" and kind in ("int", "bigint")]

    def run(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        texts = []
        for text in batch.column(at):
            text = text.as_py() or ""
            spans = find_spans(text)
            texts.append(redact_text(text, spans) if spans else text)
        for k, values in [(at, texts), *((k, list(map(len, texts))) for k in sizes)]:
            batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
        return batch

    return map_all_columns(df, text_col, run)
