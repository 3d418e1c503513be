"""Removal of long repeated word sequences, found by recompression.

Each round names runs of one symbol and then pairs of symbols, a pair being a left symbol before a
right one where the side is a bit of the symbol's own name.  A name is a hash of what it stands
for, from 128-bit hashes of the words up, so the rounds name globally without exchanging a
dictionary: equal stretches get equal symbols wherever they lie, except near their ends.  How near
is tracked: every symbol carries the range of words that its making looked at, and a range that
holds that range holds the symbol in every occurrence.

So a range of words has a signature made of names: the last round's symbols that it holds, and the
words before and after them.  Equal ranges have equal signatures, and a signature spells its range.
The signature of what a symbol's making looked at is the symbol's mark; a window of words takes the
least mark of the symbols it holds.  Marks with a single place in the corpus settle their windows as
unique; the windows of shared marks, and those that hold no symbol, are verified: by their
signatures together with an independent hash of their words, counted over the corpus.  Every
window is judged; nothing is sampled.
"""

from __future__ import annotations

import hashlib
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import ASK, Rolling, answer_repeated, answer_rows, answers, ask_repeated, ask_rows, by_bucket, deal, in_order, mix, read_repeated, through_buckets
from .common import dealt_parts, for_memory, parts_for, text_bytes

WINDOW_WORDS = 35
ROUNDS = 4
BLOCK_BYTES = 2e6
#: Text bytes whose marks, and whose windows at most, one bucket holds.
MARK_BYTES, WINDOW_BYTES = 64e6, 12e6

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SYMBOL_BASE = 0x9E3779B97F4A7C15
#: Bytes beyond which a word gets a cryptographic hash.
LONG_WORD = 64
#: Bytes hashed at a time, so that the arrays stay in cache.
_CHUNK = 1 << 18
_NONE = np.uint64((1 << 64) - 1)
_RUN, _PAIR, _SIDE, _CORE, _TAIL = (np.uint64(c) for c in (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7, 0x5851F42D4C957F2D, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Masks of the first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of every word of all texts in turn, in two halves; each text's number of words.

    Eight bytes at a time are mixed into both halves, so words up to eight bytes cannot collide;
    words beyond ``LONG_WORD`` bytes get a cryptographic hash.
    """
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (size < _CHUNK or upto == at):
            size += len(texts[upto]) + 1
            upto += 1
        # A gap before and after, and room for the last eight bytes to be read beyond the end.
        line = b"\n".join([b"", *texts[at:upto], b"\n" * 8])
        space = _SPACE[np.frombuffer(line, np.uint8)]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        bounds = np.cumsum([len(t) + 1 for t in texts[at:upto]])
        counts[at:upto] = np.diff(np.searchsorted(start, bounds), prepend=0)
        wide = np.ndarray(len(line) - 7, np.dtype("<u8"), line, strides=(1,))
        length = end - start
        both = [mix(length.astype(np.uint64) * _RUN + c) for c in (_PAIR, _SIDE)]
        active = np.arange(len(start))
        for k in range(0, LONG_WORD, 8):
            if k:
                active = active[length[active] > k]
                if not len(active):
                    break
            eight = wide[start[active] + k] & _FIRST[np.minimum(length[active] - k, 8)]
            both[0][active] = mix(both[0][active] ^ eight)
            both[1][active] = mix((both[1][active] + eight) * _CORE)
        for w in np.flatnonzero(length > LONG_WORD).tolist():
            both[0][w], both[1][w] = np.frombuffer(hashlib.blake2b(line[start[w] : end[w]], digest_size=16).digest(), np.uint64)
        found.append(np.stack(both, axis=1))
        at = upto
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64), counts


def cover_least(n: int, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least value whose range [first, last] has it, else the top value.

    Each range is two overlapping ranges of a power of two, and longer ones are pushed down to
    shorter ones.
    """
    out = np.full(n, _NONE)
    usable = first <= last
    first, last, value = first[usable], last[usable], value[usable]
    if not len(first):
        return out
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    table = None
    for j in range(int(level.max()), -1, -1):
        now = np.full(n, _NONE)
        if table is not None:
            half = 1 << j
            np.minimum(now, table, out=now)
            np.minimum(now[half:], table[:-half], out=now[half:])
        own = level == j
        np.minimum.at(now, first[own], value[own])
        np.minimum.at(now, last[own] - (1 << j) + 1, value[own])
        table = now
    return table


class Words:
    """A block's words in one line, a barrier before each document and after the last."""

    def __init__(self, texts: list[bytes], window: int = WINDOW_WORDS):
        hashes, self.counts = hash_words(texts)
        n_docs = len(texts)
        total = int(self.counts.sum()) + n_docs + 1
        self.starts = np.cumsum(self.counts + 1) - self.counts  # of each document's first word
        self.barrier = np.zeros(total, bool)
        self.barrier[self.starts - 1] = True
        self.barrier[-1] = True
        words = np.zeros((2, total), np.uint64)
        words[:, ~self.barrier] = hashes.T
        self.word = words[0]
        self.window = window
        self.roll = [Rolling(w, b) for w, b in zip(words, _WORD_BASES, strict=True)]
        behind = np.concatenate(([0], np.cumsum(self.barrier)))
        n = max(total - window + 1, 0)
        self.valid = behind[window : window + n] == behind[:n]  # windows within one document

    def symbols(self, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The last round's symbols, barriers among them: name, first word, and the range of words their making looked at."""
        sym, fixed = self.word.copy(), self.barrier.copy()
        lo = np.arange(len(sym), dtype=np.int32)
        hi = lo + np.int32(1)
        pos = lo.copy()
        for r in range(1, rounds + 1):
            # Runs: every symbol looks at both neighbours, and a run at what its members looked at.
            l2, h2 = lo.copy(), hi.copy()
            np.minimum(l2[1:], lo[:-1], out=l2[1:])
            np.minimum(l2[:-1], lo[1:], out=l2[:-1])
            np.maximum(h2[1:], hi[:-1], out=h2[1:])
            np.maximum(h2[:-1], hi[1:], out=h2[:-1])
            np.copyto(l2, lo, where=fixed)
            np.copyto(h2, hi, where=fixed)
            same = (sym[1:] == sym[:-1]) & ~fixed[1:] & ~fixed[:-1]
            if same.any():
                start = np.flatnonzero(np.concatenate(([True], ~same)))
                length = np.diff(np.append(start, len(sym)))
                sym, fixed, pos = sym[start], fixed[start], pos[start]
                run = np.flatnonzero(length > 1)
                sym[run] = mix(sym[run] * _RUN + length[run].astype(np.uint64) * _SIDE + np.uint64(r))
                l2, h2 = np.minimum.reduceat(l2, start), np.maximum.reduceat(h2, start)
            # Pairs: left before right.  A symbol has looked at the neighbour on its open side.
            free = ~fixed
            left = (mix(sym ^ np.uint64(int(_SIDE) * (2 * r + 1) & int(_NONE))) & np.uint64(1)).astype(bool) & free
            right = ~left & free
            pair = left[:-1] & right[1:]
            lo, hi = l2.copy(), h2.copy()
            np.minimum(lo[:-1], l2[1:], out=lo[:-1], where=left[:-1])
            np.maximum(hi[:-1], h2[1:], out=hi[:-1], where=left[:-1])
            np.minimum(lo[1:], l2[:-1], out=lo[1:], where=right[1:])
            np.maximum(hi[1:], h2[:-1], out=hi[1:], where=right[1:])
            at = np.flatnonzero(pair)
            sym[at] = mix(mix(sym[at] + np.uint64(r)) * _PAIR + sym[at + 1])
            keep = np.concatenate(([True], ~pair))
            sym, fixed, pos, lo, hi = sym[keep], fixed[keep], pos[keep], lo[keep], hi[keep]
        return sym, pos, lo, hi

    @cached_property
    def parsed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling]:
        """``symbols`` and hashes of their stretches."""
        found = self.symbols()
        return *found, Rolling(found[0], _SYMBOL_BASE)

    def signature(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A name for each range of words within a document: of the symbols it holds and the words around them."""
        _, pos, lo, hi, roll = self.parsed
        i, j = np.searchsorted(lo, start.astype(lo.dtype)), np.searchsorted(hi, end.astype(hi.dtype), "right")
        none = i >= j
        j = np.where(none, i, j)
        a, b = np.where(none, end, pos[i]), np.where(none, end, np.append(pos, len(self.word))[j])
        word = self.roll[0]
        return mix(mix(mix(word(start, a)) * _PAIR + roll(i, j)) * _CORE + word(b, end) * _TAIL)

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Each window's mark and the marks of all symbols that a window can hold.

        A window's mark is the least of the symbols it holds, else the top value.
        """
        n = len(self.valid)
        if not n:
            return np.full(0, _NONE), np.zeros(0, np.uint64)
        _, pos, lo, hi, _ = self.parsed
        fits = (hi - lo <= self.window) & ~self.barrier[pos]
        lo, hi = lo[fits], hi[fits]
        name = self.signature(lo, hi)
        name[name == _NONE] -= np.uint64(1)
        mark = cover_least(n, np.maximum(hi - self.window, 0), np.minimum(lo, n - 1), name)
        mark[~self.valid] = _NONE
        return mark, name

    def distinct_marks(self, mark: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the block and whether each has several places in it."""
        change = np.concatenate(([True], mark[1:] != mark[:-1])) if len(mark) else np.zeros(0, bool)
        key = np.unique(mark[change])
        key = key[key != _NONE]
        names, count = np.unique(name, return_counts=True)
        return key, (count[np.searchsorted(names, key)] > 1 if len(key) else np.zeros(0, bool))

    def candidates(self, mark: np.ndarray, name: np.ndarray, told: dict[int, np.ndarray], n_buckets: int) -> np.ndarray:
        """Windows that may have an equal one."""
        key, _ = self.distinct_marks(mark, name)
        shared = np.append(read_repeated(key, told, n_buckets), True)  # the last stands for windows without a mark
        place = np.where(mark == _NONE, len(key), np.searchsorted(key, mark))
        return np.flatnonzero(self.valid & shared[place])

    def names(self, windows: np.ndarray) -> np.ndarray:
        """Windows' signatures and independent hashes of their words, as pairs."""
        return np.stack((self.signature(windows, windows + self.window), self.roll[1](windows, windows + self.window)), axis=1)


def _distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``names``, where each row went, and their counts."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    ordered = names[order]
    new = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1))) if len(names) else np.zeros(0, bool)
    place = np.empty(len(names), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, np.bincount(place, minlength=int(new.sum()))


def _answer_windows(asked: pa.Table) -> pa.Table:
    bodies = [np.frombuffer(b, np.uint64).reshape(-1, 2) for b in asked.column("body").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(b)] for x, b in zip(asked.column("extra").to_pylist(), bodies, strict=True)]
    _, place, _ = _distinct(np.concatenate(bodies))
    count = np.bincount(place, 1 + np.concatenate(many))
    hit = (count > 1)[place]
    cuts = np.cumsum([0, *map(len, bodies)])
    return answer_rows(asked, [hit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])


def repeated_words(df: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept_sha256 (and, if asked, kept_text).

    A word goes if a window of ``window`` consecutive words that covers it has a word sequence that
    also starts anywhere else, in the same document too; windows are judged on the input.  The kept
    words are joined by single spaces.  A null text has no words; texts shorter than a window lose
    nothing.  Repeated rows are places of their own, so copies of a long enough text all lose it.
    An empty input gives no rows; further columns play no part.
    """
    size = text_bytes(df, text_col)
    n_blocks, n_marks, n_windows = (parts_for(size, for_memory(df, each), least) for each, least in ((BLOCK_BYTES, 1), (MARK_BYTES, 4), (WINDOW_BYTES, 4)))
    docs = deal(df, n_blocks, dealt_parts(df, size, n_blocks), id_col, text_col)

    def ask_marks(table: pa.Table) -> pa.Table:
        block, _, raw = in_order(table)
        words = Words(raw, window)
        return ask_repeated(block, *words.distinct_marks(*words.marks()), n_marks)

    def ask_windows(table: pa.Table, told: pa.Table) -> pa.Table:
        block, _, raw = in_order(table)
        words = Words(raw, window)
        names, _, count = _distinct(words.names(words.candidates(*words.marks(), answers(told), n_marks)))
        order, parts = by_bucket(names[:, 0], n_windows)
        names, many = names[order], (count > 1)[order]
        return ask_rows(block, [(b, names[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for b, i, j in parts])

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        block, ids, raw = in_order(table)
        words = Words(raw, window)
        both = answers(told)
        mark_told = {b - n_windows: x for b, x in both.items() if b >= n_windows}
        at = words.candidates(*words.marks(), mark_told, n_marks)
        names, place, _ = _distinct(words.names(at))
        hit = at[read_repeated(names[:, 0], {b: x for b, x in both.items() if b < n_windows}, n_windows)[place]]
        edge = np.zeros(len(words.barrier) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, digests, kept_texts = [], [], []
        for text, start, n in zip(raw, words.starts.tolist(), words.counts.tolist(), strict=True):
            lost = gone[start : start + n]
            k = int(lost.sum())
            own = text.split()
            kept = b" ".join(own if not k else compress(own, (~lost).tolist()))
            removed.append(k)
            digests.append(hashlib.sha256(kept).hexdigest())
            if texts:
                kept_texts.append(kept.decode("utf-8", "replace"))
        columns = [pa.array(ids, pa.int64()), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(columns + ([pa.array(kept_texts, pa.string())] if texts else []), names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts)

    told_marks = through_buckets(docs.groupBy("block").applyInArrow(ask_marks, ASK), answer_repeated)
    grouped = docs.groupBy("block")
    told_windows = through_buckets(grouped.cogroup(told_marks.groupBy("block")).applyInArrow(ask_windows, ASK), _answer_windows)
    # The last pass needs both answers; those about marks come with their bucket numbers moved up.
    both = told_windows.unionByName(told_marks.withColumn("bucket", (told_marks["bucket"] + n_windows).cast("int")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return docs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)

