"""Removal of long byte strings that an earlier document has, by a run-length index.

A window of ``length`` bytes takes as its mark the smallest hash among the short strings in it, so
equal windows have equal marks.  Neighbouring windows of one mark make a stretch.  Marks that only
one document has settle their windows; the stretches of other marks go, by mark, to buckets, each
distinct stretch once with its least document.  If a mark has one distinct stretch in the corpus,
its windows are all equal.  Where stretches of a mark differ, the bucket indexes them in a
run-length Burrows-Wheeler index and streams them through it for matching statistics; a window that
matches over its full length goes if the least document of the matched range is smaller.  Windows of
a hot mark, which has very many places of different surroundings, are stretches of their own and go
by a hash of the window, so no bucket gets all that surrounds a very common phrase.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import ASK, Rolling, answer_marks, answer_rows, answers, ask_marks, ask_rows, by_bucket, deal, in_order, known_ids, mix, read_marks, through_buckets
from .common import dealt_parts, for_memory, parts_for, text_bytes
from .rindex import RunIndex

LENGTH = 50
#: Bytes of the short strings that make marks.
SHORT = 20
#: A stretch has at most so many windows; longer ones, of periodic text, are several.
LONGEST_STRETCH = 512
BLOCK_BYTES = 2e6
MARK_BYTES, STRETCH_BYTES = 48e6, 4e6
#: Bytes indexed at once in a bucket.  Marks stay together, so this only bounds what is built at a time.
INDEX_BYTES = 4_000_000
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    have, out = 1, hashes
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Stretches:
    """A block's stretches: document number, start in the document, windows, mark."""

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.length = texts, length
        doc, start, count, mark, content = [], [], [], [], []
        at = 0
        while at < len(texts):
            size, upto = 0, at
            while upto < len(texts) and (size < _CHUNK or upto == at):
                size += len(texts[upto])
                upto += 1
            self._chunk(at, upto, doc, start, count, mark, content)
            at = upto
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.doc, self.start, self.count, self.mark = join(doc, np.int64), join(start, np.int64), join(count, np.int64), join(mark, np.uint64)
        self.content = join(content, np.uint64)

    def _chunk(self, at: int, upto: int, doc: list, start: list, count: list, mark: list, content: list) -> None:
        texts, length = self.texts[at:upto], self.length
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < length:
            return
        roll = Rolling(data.astype(np.uint64) + np.uint64(1), _BASE)
        n = len(data) - SHORT + 1
        place = np.arange(n)
        least = window_minima(roll(place, place + SHORT), length - SHORT + 1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(sizes)
        inside = np.ones(len(least), bool)
        for s, e in zip((end - sizes).tolist(), end.tolist(), strict=True):
            inside[max(s, e - length + 1) : e] = False
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        windows = np.diff(np.append(first, len(least)))
        ok = inside[first]
        first, windows = first[ok], windows[ok]
        parts = -(-windows // LONGEST_STRETCH)
        if (parts > 1).any():
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(first, parts) + nth * LONGEST_STRETCH
            windows = np.minimum(np.repeat(windows, parts) - nth * LONGEST_STRETCH, LONGEST_STRETCH)
        owner = np.searchsorted(end, first, side="right")
        doc.append(owner + at)
        start.append(first - (end - sizes)[owner])
        count.append(windows)
        mark.append(least[first])
        content.append(roll(first, first + windows + length - 1))

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct marks; whether several of the block's documents have each, its stretches, and a bit of 64 for each one's content."""
        order = np.argsort(self.mark, kind="stable")
        key, first, n = np.unique(self.mark[order], return_index=True, return_counts=True)
        if not len(key):
            return key, np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        around = np.bitwise_or.reduceat(np.uint64(1) << (mix(self.content[order]) & np.uint64(63)), first)
        return key, self.doc[order[first]] != self.doc[order[first + n - 1]], n.astype(np.int64), around

    def narrow(self, told: dict[int, np.ndarray], n_buckets: int) -> None:
        """Keep the stretches whose mark another document has; those of hot marks as single windows."""
        key, at = np.unique(self.mark, return_inverse=True)
        shared, hot = (x[at] for x in read_marks(key, told, n_buckets))
        hot &= shared
        doc, start, count, mark = ([x[shared & ~hot]] for x in (self.doc, self.start, self.count, self.mark))
        if hot.any():
            w = self.count[hot]
            doc.append(np.repeat(self.doc[hot], w))
            start.append(np.repeat(self.start[hot], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w))
            count.append(np.ones(len(doc[1]), np.int64))
            names = b"".join([hashlib.blake2b(self.texts[d][s : s + self.length], digest_size=8).digest() for d, s in zip(doc[1].tolist(), start[1].tolist(), strict=True)])
            mark.append(np.frombuffer(names, np.uint64))
        self.doc, self.start, self.count, self.mark = (np.concatenate(x) for x in (doc, start, count, mark))

    def distinct(self, ids: list[int]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct stretches in order of appearance, their marks and least documents; where each went."""
        seen: dict[bytes, int] = {}
        texts, extra = self.texts, self.length - 1
        place = np.fromiter(
            (seen.setdefault(texts[d][s : s + c + extra], len(seen)) for d, s, c in zip(self.doc.tolist(), self.start.tolist(), self.count.tolist(), strict=True)),
            np.int64,
            len(self.doc),
        )
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, place, known_ids(ids)[self.doc])
        mark = np.zeros(len(seen), np.uint64)
        mark[place] = self.mark
        return list(seen), mark, least, place


_ZSTD = pa.Codec("zstd", compression_level=3)


def _pack(strings: list[bytes], mark: np.ndarray, least: np.ndarray) -> tuple[bytes, bytes]:
    """Stretches as two compressed values: their number, marks, least documents and sizes; their bytes."""
    sizes = np.fromiter(map(len, strings), np.uint32, len(strings))
    body = _ZSTD.compress(mark.tobytes() + least.tobytes() + sizes.tobytes(), asbytes=True)
    return len(strings).to_bytes(4, "little") + body, _ZSTD.compress(b"".join(strings), asbytes=True)


def _unpack(body: bytes, blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    body = _ZSTD.decompress(body[4:], 20 * n, asbytes=True)
    mark, least, sizes = np.frombuffer(body, np.uint64, n), np.frombuffer(body, np.int64, n, 8 * n), np.frombuffer(body, np.uint32, n, 16 * n)
    cuts = np.concatenate(([0], np.cumsum(sizes.astype(np.int64)))).tolist()
    blob = _ZSTD.decompress(blob, cuts[-1], asbytes=True)
    return [blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], mark, least


def _answer_stretches(length: int):
    def run(asked: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        places, leasts, marks = [], [], []
        for body, blob in zip(asked.column("body").to_pylist(), asked.column("extra").to_pylist(), strict=True):
            strings, mark, least = _unpack(body, blob)
            places.append(np.fromiter((seen.setdefault(s, len(seen)) for s in strings), np.int64, len(strings)))
            leasts.append(least)
            marks.append(mark)
        strings = list(seen)
        place, asked_least = np.concatenate(places), np.concatenate(leasts)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, place, asked_least)
        mark = np.zeros(len(strings), np.uint64)
        mark[place] = np.concatenate(marks)
        windows = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
        offset = np.cumsum(windows) - windows
        found = np.repeat(least, windows)  # right for marks with one distinct stretch
        order = np.argsort(mark, kind="stable")
        _, first, count = np.unique(mark[order], return_index=True, return_counts=True)
        group, size = [], 0
        for a, n in [*zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True), (0, 0)]:
            own = order[a : a + n].tolist()
            if group and (not n or size > INDEX_BYTES):
                index = RunIndex([strings[k] for k in group], least[group], length)
                got = index.stream([strings[k] for k in group])
                w = windows[group]
                found[np.repeat(offset[group], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)] = got
                group, size = [], 0
            group += own
            size += sum(len(strings[k]) for k in own)
        bits = []
        for own, low in zip(places, leasts, strict=True):
            w = windows[own]
            at = np.repeat(offset[own], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            bits.append(found[at] < np.repeat(low, w))
        return answer_rows(asked, bits)

    return run


def repeated_bytes(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, if asked, kept).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller doc_id; strings lie within one document and are judged on the input.  A null text
    counts as empty; texts shorter than ``length`` lose nothing.  Rows that share a doc_id count as
    one document and don't remove each other's text; a missing doc_id counts as the largest.  An empty input gives no rows; further columns
    play no part.
    """
    if length <= SHORT:
        raise ValueError(f"strings need more than {SHORT} bytes")
    total = text_bytes(df, text_col)
    n_blocks, n_marks, n_stretches = (parts_for(total, for_memory(df, each), least) for each, least in ((BLOCK_BYTES, 1), (MARK_BYTES, 4), (STRETCH_BYTES, 4)))
    docs = deal(df, n_blocks, dealt_parts(df, total, n_blocks), id_col, text_col)

    def ask_shared(table: pa.Table) -> pa.Table:
        block, _, raw = in_order(table)
        return ask_marks(block, *Stretches(raw, length).marks(), n_marks)

    def ask_stretches(table: pa.Table, told: pa.Table) -> pa.Table:
        block, ids, raw = in_order(table)
        own = Stretches(raw, length)
        own.narrow(answers(told), n_marks)
        strings, mark, least, _ = own.distinct(ids)
        order, parts = by_bucket(mark, n_stretches)
        return ask_rows(block, [(b, *_pack([strings[k] for k in order[i:j].tolist()], mark[order[i:j]], least[order[i:j]])) for b, i, j in parts])

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        block, ids, raw = in_order(table)
        both = answers(told)
        own = Stretches(raw, length)
        own.narrow({b - n_stretches: x for b, x in both.items() if b >= n_stretches}, n_marks)
        strings, mark, least, place = own.distinct(ids)
        windows = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
        order, parts = by_bucket(mark, n_stretches)
        bits = [both[b][: int(windows[order[i:j]].sum())] for b, i, j in parts]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        offset = np.zeros(len(strings), np.int64)
        offset[order] = np.cumsum(windows[order]) - windows[order]
        # Windows of all shared stretches: told to go, or their document isn't the stretch's least here.
        w = windows[place]
        step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        later = known_ids(ids)[own.doc] > least[place]
        gone = flat[np.repeat(offset[place], w) + step] | np.repeat(later, w)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.cumsum(sizes) - sizes
        hit = (np.repeat(begin[own.doc] + own.start, w) + step)[gone]
        edge = np.zeros(int(sizes.sum()) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + length, -1)
        lost = np.cumsum(edge[:-1]) > 0
        removed, spans, digests, kept = [], [], [], []
        for text, a, n in zip(raw, begin.tolist(), sizes.tolist(), strict=True):
            mask = lost[a : a + n]
            k = int(mask.sum())
            rest = text if not k else np.frombuffer(text, np.uint8)[~mask].tobytes()
            removed.append(k)
            spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            digests.append(hashlib.sha256(rest).hexdigest())
            if kept_bytes:
                kept.append(rest)
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(columns + [pa.array(kept, pa.binary())] * kept_bytes, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept_bytes)

    told_marks = through_buckets(docs.groupBy("block").applyInArrow(ask_shared, ASK), answer_marks)
    told = through_buckets(docs.groupBy("block").cogroup(told_marks.groupBy("block")).applyInArrow(ask_stretches, ASK), _answer_stretches(length))
    both = told.unionByName(told_marks.withColumn("bucket", (told_marks["bucket"] + n_stretches).cast("int")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_bytes
    return docs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)
