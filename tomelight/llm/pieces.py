"""SentencePiece encoding and decoding by suffix-array matching.

The distinct stretches of a batch of texts are laid end to end and indexed by a suffix array; a
binary search finds the range of suffixes that start with each piece of the vocabulary, so all
occurrences of all pieces come out at once.  Sorted by where they end, these edges are relaxed left
to right: an edge extends the encoding that ends where it starts if the two meeting pieces, taken
alone, encode to themselves.  That relaxation gives the merges' own result.

Two characters that are neighbours in no piece never merge, so a text falls into stretches there,
and stretches recur: each is encoded once in a worker's memory.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import fill_cores
from .common import id_and_text

SPACE = "▁"
#: Words and stretches that a worker goes on remembering into its next batch, at most.
CACHE_ENTRIES = 300_000
#: Stretches of more characters are relaxed one by one, not in step with the others.
LONG_STRETCH = 256
#: Texts that are learnt together, and new stretches that one suffix array indexes, in characters.
LEARN_CHARS, INDEX_CHARS = 16_000_000, 1_000_000


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` in the order of their next ``depth`` codes, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        follow = np.zeros_like(rank)
        follow[:-width] = rank[width:]
        key = rank * (len(codes) + 2) + follow
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        width *= 2
    return order


class PieceCoder:
    """A piece vocabulary with merges by score and bytes for unknown characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: model.get_score(i) for i in normal}
        self.touch = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # The same as a table by the characters' numbers; the last number stands for all others.
        chars = sorted({c for pair in self.touch for c in pair})
        self.number = np.full(0x110000, len(chars), np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(len(chars))
        self.touching = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        left, right = zip(*((ord(a), ord(b)) for a, b in self.touch), strict=True)
        self.touching[self.number[list(left)], self.number[list(right)]] = True
        # Known pairs of pieces (the left one's id times 2**16 plus the right one's), sorted, and whether they meet.
        self.pair, self.pair_meets = np.zeros(0, np.int64), np.zeros(0, bool)
        # Pieces whose characters encode to them, as a matrix of codes by length.
        self.usable = sorted((p for p in self.ids if self.merged(list(p)) == [p]), key=lambda p: (len(p), p))
        self.usable_ids = np.array([self.ids[p] for p in self.usable])
        self.longest = max(map(len, self.usable))
        self.lengths = np.array([len(p) for p in self.usable])
        self.matrix = np.zeros((len(self.usable), self.longest), np.uint32)
        for k, p in enumerate(self.usable):
            self.matrix[k, : len(p)] = [ord(c) for c in p]
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges' own result; only for a piece or two at a time."""
        scores = self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def meets(self, key: np.ndarray) -> np.ndarray:
        """Whether the pieces of each pair, taken together, encode to themselves."""
        at = np.searchsorted(self.pair, key)
        known = at < len(self.pair)
        known[known] = self.pair[at[known]] == key[known]
        if not known.all():
            fresh = np.unique(key[~known])
            found = np.zeros(len(fresh), bool)
            for k, (a, b) in enumerate(zip((fresh >> 16).tolist(), (fresh & 0xFFFF).tolist(), strict=True)):
                left, right = self.pieces[a], self.pieces[b]
                found[k] = left[-1] + right[0] not in self.touch or self.merged(list(left + right)) == [left, right]
            order = np.argsort(pair := np.concatenate((self.pair, fresh)), kind="stable")
            self.pair, self.pair_meets = pair[order], np.concatenate((self.pair_meets, found))[order]
            at = np.searchsorted(self.pair, key)
        return self.pair_meets[at]

    def cut(self, texts: list[str]) -> list[list[str]]:
        """Each text's stretches, between which no merge can pass."""
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        number = self.number[codes]
        apart = np.ones(len(codes) + 1, bool)
        apart[1:-1] = ~self.touching[number[:-1], number[1:]]
        apart[begin] = apart[begin + sizes] = False
        stops = np.flatnonzero(apart[:-1])
        own = np.searchsorted(begin, stops, side="right") - 1
        out = [[t] for t in texts]
        edges = np.searchsorted(own, np.arange(len(texts) + 1))
        stops -= begin[own]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            inner = stops[edges[k] : edges[k + 1]].tolist()
            out[k] = [texts[k][a:b] for a, b in zip([0, *inner], [*inner, int(sizes[k])], strict=True)]
        return out

    def unknown(self, char: str) -> bytes:
        own = self.ids.get(char)
        found = [own] if own is not None else [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return np.array(found, np.uint16).tobytes()

    def learn(self, texts: list[str]) -> None:
        """Encode, in bulk, the words of ``texts`` that aren't known yet."""
        if len(self.stretches) > CACHE_ENTRIES:
            self.stretches = {}
        fresh: set[str] = set()
        for text in texts:
            fresh.update(self.split_words(text))
        if len(self.words) > CACHE_ENTRIES:  # words that come back stay
            self.words = {w: self.words[w] for w in fresh if w in self.words}
        fresh.difference_update(self.words)
        order = sorted(fresh)
        cuts = list(zip(order, self.cut([SPACE + word for word in order]), strict=True)) if order else []
        todo: dict[str, None] = {}
        size = 0
        for _, parts in cuts:
            for s in parts:
                if s not in self.stretches and s not in todo:
                    todo[s] = None
                    size += len(s) + 1
                    if size > INDEX_CHARS:
                        self.index(list(todo))
                        todo, size = {}, 0
        self.index(list(todo))
        known = self.stretches
        for word, parts in cuts:
            self.words[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[s] for s in parts])

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where which usable piece occurs in ``codes`` (zeros separate): starts, piece numbers."""
        order = suffix_array(codes, self.longest)
        padded = np.concatenate([codes, np.zeros(self.longest, np.uint32)])
        column = np.arange(self.longest)
        inside = column[None, :] < self.lengths[:, None]
        bounds = []
        for upper in (False, True):
            low, high = np.zeros(len(self.usable), np.int64), np.full(len(self.usable), len(order), np.int64)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                suffix = padded[order[np.minimum(mid, len(order) - 1)][:, None] + column]
                differ = (suffix != self.matrix) & inside
                first = differ.argmax(axis=1)
                rows = np.arange(len(first))
                some = differ[rows, first]
                before = np.where(some, suffix[rows, first] < self.matrix[rows, first], upper)
                low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
            bounds.append(low)
        count = bounds[1] - bounds[0]
        piece = np.repeat(np.arange(len(self.usable)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[0], count)
        return order[place], piece

    def index(self, stretches: list[str]) -> None:
        """Encode ``stretches`` together and remember them."""
        single = [s for s in stretches if len(s) == 1]
        for s in single:
            self.stretches[s] = self.unknown(s)
        stretches = [s for s in stretches if len(s) > 1]
        if not stretches:
            return
        codes = np.frombuffer("\0".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        start, piece = self.occurrences(codes)
        end, ids = start + self.lengths[piece], self.usable_ids[piece]
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        begin = np.cumsum(sizes + 1) - sizes - 1
        own = np.searchsorted(begin, start, side="right") - 1
        reach = end - begin[own]
        sort = np.lexsort((start, end, reach))
        start, end, ids, reach, own = start[sort], end[sort], ids[sort], reach[sort], own[sort]
        first = np.zeros(len(codes) + 1, bool)
        first[begin] = True
        back = np.full(len(codes) + 1, -1, np.int64)  # where the last piece of the encoding that ends here starts
        last = np.full(len(codes) + 1, -1, np.int64)
        alone = sizes[own] > LONG_STRETCH
        if alone.any():
            order = np.lexsort((start[alone], end[alone]))
            self.relax(*(x[alone][order].tolist() for x in (start, end, ids)), first, back, last)
            start, end, ids, reach = start[~alone], end[~alone], ids[~alone], reach[~alone]
        cuts = np.flatnonzero(np.diff(reach, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(reach)], strict=False):  # all stretches in step
            a, b, t = start[i:j], end[i:j], ids[i:j]
            good = first[a].copy()
            open_ = np.flatnonzero(~good & (last[a] >= 0))
            good[open_] = self.meets((last[a[open_]] << 16) + t[open_])
            hit = np.flatnonzero(good)
            hit = hit[np.concatenate(([True], np.diff(b[hit]) != 0))] if len(hit) else hit
            back[b[hit]], last[b[hit]] = a[hit], t[hit]
        # A character outside the vocabulary touches nothing, so every longer stretch has an encoding.
        at, alive, found, whose, depth = begin + sizes, np.arange(len(stretches)), [], [], []
        step = 0
        while len(alive):
            found.append(last[at])
            whose.append(alive)
            depth.append(np.full(len(alive), step))
            at = back[at]
            more = at > begin[alive]
            at, alive, step = at[more], alive[more], step - 1
        ids, whose = np.concatenate(found), np.concatenate(whose)
        raw = ids[np.lexsort((np.concatenate(depth), whose))].astype(np.uint16).tobytes()
        stops = (2 * np.cumsum(np.bincount(whose, minlength=len(stretches)))).tolist()
        at = 0
        for s, stop in zip(stretches, stops, strict=True):
            self.stretches[s] = raw[at:stop]
            at = stop

    def relax(self, start: list[int], end: list[int], ids: list[int], first: np.ndarray, back: np.ndarray, last: np.ndarray) -> None:
        """Relax edges in the order of their ends, one at a time."""
        known: dict[int, bool] = {}
        came: dict[int, int] = {}
        for a, b, t in zip(start, end, ids, strict=True):
            if b in came:
                continue
            if not first[a]:
                if a not in came:
                    continue
                key = (came[a] << 16) + t
                if key not in known:
                    known[key] = bool(self.meets(np.array([key]))[0])
                if not known[key]:
                    continue
            came[b] = t
            back[b], last[b] = a, t

    def split_words(self, text: str) -> list[str]:
        """What follows each space mark, with any marks beyond the first; a text starts with one."""
        if SPACE not in text and "  " not in text and not text.startswith(" "):
            return text.split(" ")
        return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint16)
        words = self.split_words(text)
        try:
            found = b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self.learn([text])
            found = b"".join(map(self.words.__getitem__, words))
        return np.frombuffer(found, np.uint16)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; a space mark in the encoded text comes back as a space."""
        out = b"".join(map(self.piece_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    @functools.cached_property
    def piece_bytes(self) -> list[bytes]:
        return [self.bytes_of.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]


@functools.lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def _encode(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for whole in batches:
            sizes = np.array([len(t.as_buffer() or b"") for t in whole.column("text")], np.int64)
            part = np.cumsum(sizes) // LEARN_CHARS
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for at, to in zip(cuts, [*cuts[1:], whole.num_rows], strict=False):
                batch = whole.slice(at, to - at)
                texts = batch.column("text").to_pylist()
                code.learn(texts)
                ids = [code.encode(t) for t in texts]
                if digest:
                    back = [code.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                    crc = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
                    columns = [pa.array(list(map(len, ids)), pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row's whole text, without begin or end ids.

    A null text counts as empty and has no ids.  Repeated rows each give a row, an empty input
    none; further columns play no part.
    """
    return fill_cores(id_and_text(df, id_col, text_col)).mapInArrow(_encode(path, False), "doc_id long, ids array<int>")


def piece_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode it again: doc_id, n_tokens, ids_crc32, round_trip.

    ``round_trip`` says that decoding gave the text back, a space mark in it as a space.  A null
    text counts as empty and has no tokens.  Repeated rows each give a row, an empty input none;
    further columns play no part.
    """
    return fill_cores(id_and_text(df, id_col, text_col)).mapInArrow(_encode(path, True), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def decode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that each row's ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            texts = [code.decode(np.array(i.as_py() or [], np.int64)) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
