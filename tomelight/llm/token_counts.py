"""Token counts by prefix dynamic programming.

For every prefix of a piece of text, the table holds the last token of the prefix's encoding and
the number of its tokens.  A token extends the encoding of what lies before it exactly if the two
meeting tokens, taken alone, encode to themselves; so the table grows left to right with no merge
loop over the text, and it answers any truncation or budget question without encoding again.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import fill_cores
from .common import Memo, id_and_text

#: Keys that a worker keeps, per generation, of texts' chunks, of pieces and of pairs of tokens.
CACHE_ENTRIES = 250_000
#: Stands for the end of a word in keys of the automaton.
_END = "\0"
#: What lies between white space, as the library sees it.
_CHUNK = re.compile("[^ \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters whose class, case and composition the library and Python see alike.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ſ–—‘’“”…]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


def piece_pattern():
    """The fixed pattern of the vocabulary's own splitter."""
    import regex

    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class PrefixCounter:
    """Prefix tables for a vocabulary of merges with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_rx = re.compile("|".join(map(re.escape, self.specials)))
        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        self.pattern = piece_pattern()
        # Tokens whose characters encode to them; only such a token can be part of an encoding.
        self.tokens: list[list[str]] = []
        self.automaton = ahocorasick.Automaton()
        for token in model["vocab"]:
            if token not in self.specials and self.merged(self.symbols(token)) == [token]:
                self.automaton.add_word(self.key(token), (len(self.tokens), len(self.key(token))))
                self.tokens.append(self.symbols(token))
        self.automaton.make_automaton()
        #: Characters of the longest token, so an ended token begins no further back.
        self.longest = max(map(len, map(self.key, model["vocab"])))
        self.meets = Memo(self._meet, 4 * CACHE_ENTRIES)
        self.pieces = Memo(self.count_piece, CACHE_ENTRIES)
        self.chunks = Memo(lambda chunk: sum(map(self.pieces.__getitem__, self.split(chunk))), CACHE_ENTRIES)

    def key(self, token: str) -> str:
        return token.removesuffix(self.suffix) + _END if self.suffix and token.endswith(self.suffix) else token

    def split(self, chunk: str) -> list[str]:
        """Byte-level pieces of a plain chunk without white space."""
        out = self.pattern.findall(chunk.lower())
        return [p if p.isascii() else self.mapped(p) for p in out]

    def mapped(self, piece: str) -> str:
        return "".join(map(self.alphabet.__getitem__, piece.encode()))

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges' own result; only for a token or two at a time."""
        ranks = self.ranks
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = ranks.get((symbols[i], symbols[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            own = list(token.removesuffix(self.suffix))
            return [*own[:-1], own[-1] + self.suffix] if own else [token]
        return list(token)

    def _meet(self, pair: tuple[int, int]) -> bool:
        left, right = (self.tokens[t] for t in pair)
        joined = self.merged(left + right)
        return len(joined) == 2 and len(joined[0]) == sum(map(len, left))

    def table(self, piece: str, ended: bool = True) -> list[int]:
        """Tokens of each prefix of ``piece`` within a word; the last entry is the ended word's."""
        n = len(piece)
        last, count = [-1] * (n + 2), [0] * (n + 2)
        seen = 0  # prefixes up to here have their entry
        meets = self.meets
        for at, (token, size) in self.automaton.iter(piece + _END if ended else piece):
            j = at + 1
            if j <= seen:
                continue
            i = j - size
            if not i or last[i] >= 0 and meets[last[i], token]:
                last[j], count[j], seen = token, count[i] + 1, j
        return count

    def count_piece(self, piece: str) -> int:
        return self.table(piece)[len(piece) + 1] if piece else 0

    def prefix_counts(self, piece: str) -> list[int]:
        """Tokens of every prefix of ``piece``, each taken as a word of its own.

        One table serves all prefixes: ending a word only adds the choice of its last token.
        """
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for at, (token, size) in self.automaton.iter(piece):
            i, j = at + 1 - size, at + 1
            if last[j] < 0 and (not i or self.meets[last[i], token]):
                last[j], count[j] = token, count[i] + 1
        out = [0]
        for j in range(1, n + 1):
            for at, (token, size) in self.automaton.iter(piece[max(0, j - self.longest) : j] + _END):
                if at == min(self.longest, j):
                    i = j + 1 - size
                    if not i or self.meets[last[i], token]:
                        out.append(count[i] + 1)
                        break
        return out

    def segments(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """A special string as (string, []), else a stretch of text as (None, byte-level pieces)."""
        at = 0
        for m in self.special_rx.finditer(text) if "<|" in text else ():
            yield None, self.stretch(text[at : m.start()])
            yield m.group(), []
            at = m.end()
        yield None, self.stretch(text[at:])

    def stretch(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def chunk_counts(self, text: str) -> np.ndarray:
        """Tokens of each chunk between white space; for text that isn't plain, of each piece."""
        if "<|" not in text and not PLAIN.search(text):
            return np.fromiter(map(self.chunks.__getitem__, text.split()), np.int64)
        found: list[int] = []
        for special, pieces in self.segments(text):
            found += [1] if special else map(self.pieces.__getitem__, pieces)
        return np.array(found, np.int64)

    def count(self, text: str) -> int:
        return int(self.chunk_counts(text).sum())

    def cut(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of a plain ``text`` with at most ``budget`` tokens.

        For text that isn't plain, of the longest such prefix that ends where white space or the
        text's end follows.  Counts at the chunks' ends come from one pass, those inside the chunk
        that goes beyond the budget from its pieces' tables.
        """
        plain = not (PLAIN.search(text) or "<|" in text)
        spans = [m.span() for m in (re.finditer(r"\S+", text) if plain else _CHUNK.finditer(text))]
        count = self.chunks.__getitem__ if plain else self.count
        prefix = np.cumsum(np.fromiter((count(text[a:b]) for a, b in spans), np.int64, len(spans)))
        k = int(np.searchsorted(prefix, budget, side="right"))
        if k == len(spans):
            return len(text)
        before = int(prefix[k - 1]) if k else 0
        if plain:
            return spans[k][0] + self._within(text[slice(*spans[k])], budget - before)
        return spans[k - 1][1] if k else 0

    def _within(self, chunk: str, left: int) -> int:
        """Characters of the longest prefix of a plain chunk with at most ``left`` tokens."""
        for m in self.pattern.finditer(chunk.lower()):
            piece = m.group()
            n = self.pieces[piece if piece.isascii() else self.mapped(piece)]
            if n > left:
                return m.start() + max(j for j, size in enumerate(self.piece_prefixes(piece)) if size <= left)
            left -= n
        return len(chunk)

    def piece_prefixes(self, piece: str) -> list[int]:
        """Tokens of the first 0, 1, ... characters of a piece, each as text of its own."""
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # part of a contraction is no contraction
            return [sum(map(self.pieces.__getitem__, self.split(piece[:j]))) for j in range(len(piece) + 1)]
        if piece.isascii():
            return self.prefix_counts(piece)
        sizes = np.cumsum([0, *(len(c.encode()) for c in piece)])
        counts = self.prefix_counts(self.mapped(piece))
        return [counts[k] for k in sizes.tolist()]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in batches:
            sizes, tokens, within = [], [], []
            for text in batch.column("text"):
                buffer = text.as_buffer()
                sizes.append(buffer.size if buffer is not None else 0)
                whole = text.as_py()
                tokens.append(int(table.chunk_counts(whole).sum()))
                within.append(len(whole) if tokens[-1] <= limit else table.cut(whole, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(within, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "within_chars"],
            )

    return run


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_tokens, over_limit, within_chars.

    The last is how many code points the longest prefix of at most ``limit`` tokens has (see ``cut``).

    Counts are those of the vocabulary's own library without added special tokens; its special
    strings inside a text count as one token each.  A null text counts as empty, with no tokens.
    Repeated rows each give a row; an empty input gives none; further columns play no part.
    """
    return fill_cores(id_and_text(df, id_col, text_col)).mapInArrow(_counts(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, within_chars long")


def truncated(df: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the longest prefix of each text within ``budget`` tokens, as ``PrefixCounter.cut`` finds it.

    A null text counts as empty.  Repeated rows each give a row; an empty input gives none; further
    columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            cut = [t[: table.cut(t, budget)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cut, pa.string())], names=["doc_id", "text"])

    return fill_cores(id_and_text(df, id_col, text_col)).mapInArrow(run, "doc_id long, text string")
