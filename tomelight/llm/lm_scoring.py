"""Scoring of texts by a smoothed n-gram model, as a weighted backoff automaton.

The model mixes each order with the one below it: after a context h that training texts have c(h)
times, a token w has the probability (c(h,w) + m·p(w | shorter h)) / (c(h) + m), and single tokens
have add-a-bit probabilities.  So seen n-grams are arcs with a weight of their own, and every state,
a context seen in training, has a failure arc of weight m / (c(h) + m) to the next shorter context.

The counts of a whole corpus fit no task.  Documents are dealt into blocks, a block asks the buckets
of n-grams for the counts of those it has, and builds the part of the automaton that its own texts
can walk; each text is one walk from left to right.  N-grams longer than two are asked for only
where other blocks have both n-grams one shorter; the block has counted all others itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, ASK, ask_rows, deal, get_counts, in_order, mix, put_counts
from .common import dealt_parts, for_memory, parts_for, text_bytes
from .substring import hash_words

#: What single tokens' counts are raised by.
ADDED = 0.1
#: How many occurrences of a context the shorter one counts as, for pairs, triples and so on.
STRENGTHS = (1000.0, 10.0)
FOLDS = 10
BLOCK_BYTES = 4e6
#: Text bytes whose words, whose pairs, and whose longer n-grams one bucket holds.
WORD_BYTES, PAIR_BYTES, LONGER_BYTES = 96e6, 32e6, 64e6
#: Bits that tell n-grams of two tokens and more apart, beside those that count the text's bytes in fours: one in a
#: million has another's key, at any size of the input.  At least so many in all, so that small inputs have none.
SPARE_BITS, LEAST_BITS = 18, 46

_START, _END = np.uint64(0x9216D5D98979FB1B), np.uint64(0xD1310BA698DFB5AC)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """Whether the CRC-32 of the identifier in decimal is divisible by ``folds``; a missing one counts as empty."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def bits_for(size: float) -> int:
    """Bits of the keys of n-grams of two tokens and more, for ``size`` bytes of text."""
    return min(63, max(LEAST_BITS, SPARE_BITS + int(size / 4).bit_length()))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in order and each one's number among them.

    Keys are sorted together with their places in one word each, as far as both have room; where keys
    that differ could not be told apart that way, they are sorted as they are.
    """
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64)
    low = np.uint64(n.bit_length())
    free = np.uint64(64 - max(1, int(keys.max()).bit_length()))
    both = keys << free >> low << low | np.arange(n, dtype=np.uint64)
    both.sort()
    place = (both & np.uint64((1 << n.bit_length()) - 1)).astype(np.int64)
    ordered = keys[place]
    new = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    if (new[1:] & (both[1:] >> low == both[:-1] >> low)).any():
        return np.unique(keys, return_inverse=True)
    number = np.empty(n, np.int64)
    number[place] = np.cumsum(new) - 1
    return ordered[new], number


def put_keys(keys: np.ndarray) -> bytes:
    """Keys in ascending order, as differences of as many bytes as the largest takes; the first byte says how many."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def get_keys(packed: bytes) -> np.ndarray:
    width = packed[0]
    steps = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


def put_answers(shared: np.ndarray, others: np.ndarray) -> bytes:
    """A bit a key for ``shared``, one for counts above 0, and those counts."""
    some = others > 0
    return np.packbits(shared).tobytes() + np.packbits(some).tobytes() + put_counts(others[some])


def get_answers(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    flags = (n + 7) // 8
    bits = np.frombuffer(packed, np.uint8, 2 * flags).reshape(2, -1)
    shared, some = (np.unpackbits(b)[:n].astype(bool) for b in bits)
    others = np.zeros(n, np.int64)
    others[some] = get_counts(packed[2 * flags :], int(some.sum()))
    return shared, others


class Grams:
    """A block's n-grams of one order: distinct keys, each place's number among them, and their counts.

    ``own`` are the counts in the block's training texts, ``others`` those in other blocks' once told;
    ``shared`` tells whether other blocks have it at all, in texts that are held out too.
    """

    def __init__(self, key: np.ndarray, places: np.ndarray, train: np.ndarray):
        self.distinct, number = distinct(key[places])
        self.number = np.full(len(key), -1, np.int64)
        self.number[places] = number
        self.place = np.empty(len(self.distinct), np.int64)  # any one of those that have it
        self.place[number] = places
        self.own = np.bincount(number, train[places], len(self.distinct)).astype(np.int64)
        self.others = np.zeros(len(self.distinct), np.int64)
        self.shared = np.zeros(len(self.distinct), bool)

    @property
    def total(self) -> np.ndarray:
        return self.own + self.others


class Line:
    """A block's texts in one line: of each document a start, its words in lower case and an end."""

    def __init__(self, ids: list[int | None], texts: list[bytes], folds: int, bits: int):
        self.bits = bits
        words, counts = hash_words([t.lower() for t in texts])
        self.counts = counts + 1  # tokens: words and the end
        size = int(self.counts.sum()) + len(texts)
        self.starts = np.cumsum(self.counts + 1) - self.counts - 1
        self.token = np.empty(size, np.uint64)
        inner = np.ones(size, bool)
        inner[self.starts] = inner[self.starts + self.counts] = False
        self.token[inner] = words[:, 0]
        self.token[self.starts], self.token[self.starts + self.counts] = _START, _END
        self.held_out = np.array([is_held_out(i, folds) for i in ids], bool)
        self.train = np.repeat(~self.held_out, self.counts + 1).astype(float)
        self.depth = np.arange(size) - np.repeat(self.starts, self.counts + 1)  # tokens before, in the same text
        self.kept: dict[int, Grams] = {}

    def keys(self, n: int) -> np.ndarray:
        """A key for the n-gram that ends at each place; what reaches over a text's start is of no use."""
        key = self.token
        for k in range(2, n + 1):
            longer = np.zeros(len(key), np.uint64)
            longer[1:] = mix(mix(key[:-1] * _LEFT + np.uint64(k)) + self.token[1:] * _RIGHT)
            key = longer
        return key if n == 1 else key >> np.uint64(64 - self.bits)

    def grams(self, n: int) -> Grams:
        if n not in self.kept:
            self.kept[n] = Grams(self.keys(n), np.flatnonzero(self.depth >= max(n - 1, 1)), self.train)
        return self.kept[n]

    def to_ask(self, n: int) -> np.ndarray:
        """Which distinct n-grams other blocks may have; known once what is one shorter has been told."""
        own = self.grams(n)
        if n <= 2:
            return np.ones(len(own.distinct), bool)
        shorter = self.grams(n - 1)
        return shorter.shared[shorter.number[own.place]] & shorter.shared[shorter.number[own.place - 1]]


class Exchange:
    """Buckets of n-grams by order, numbered through; a bucket is a range of keys."""

    def __init__(self, sizes: Sequence[int], bits: int):
        self.sizes, self.bits = list(sizes), bits
        self.offsets = np.cumsum([0, *sizes]).tolist()

    def parts(self, n: int, keys: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(bucket, its least key, from, to) of ascending ``keys``."""
        size, bits = self.sizes[n - 1], 64 if n == 1 else self.bits
        bounds = [(b << bits) // size for b in range(size)]
        cuts = [*np.searchsorted(keys, np.array(bounds, np.uint64)).tolist(), len(keys)]
        return [(self.offsets[n - 1] + b, bounds[b], i, j) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]

    def ask(self, block: int, line: Line, orders: Sequence[int]) -> pa.Table:
        rows = []
        for n in orders:
            asked = line.to_ask(n)
            keys, own = line.grams(n).distinct[asked], line.grams(n).own[asked]
            rows += [(b, put_keys(keys[i:j] - np.uint64(least)), put_counts(own[i:j])) for b, least, i, j in self.parts(n, keys)]
        return ask_rows(block, rows)

    def read(self, line: Line, told: pa.Table, orders: Sequence[int]) -> None:
        """Fill in what ``told`` has about other blocks, shorter n-grams first."""
        answers = dict(zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist(), strict=True))
        for n in orders:
            grams, asked = line.grams(n), np.flatnonzero(line.to_ask(n))
            for b, _, i, j in self.parts(n, grams.distinct[asked]):
                grams.shared[asked[i:j]], grams.others[asked[i:j]] = get_answers(answers[b], j - i)

    @staticmethod
    def _bucket(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
        keys = [get_keys(b) for b in asked.column("body").to_pylist()]
        counts = [get_counts(x, len(k)) for x, k in zip(asked.column("extra").to_pylist(), keys, strict=True)]
        return np.concatenate(keys), np.concatenate(counts), np.cumsum([0, *map(len, keys)]).tolist()

    def answer(self, asked: pa.Table) -> pa.Table:
        """For each asked key whether another block asked for it too, and its count in other blocks."""
        keys, counts, cuts = self._bucket(asked)
        _, number = distinct(keys)
        others = np.bincount(number, counts).astype(np.int64)[number] - counts
        shared = (np.bincount(number) > 1)[number]
        bits = [put_answers(shared[a:b], others[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.Table.from_arrays([asked.column("block").combine_chunks(), asked.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], names=["block", "bucket", "bits"])

    def totals(self, asked: pa.Table) -> pa.Table:
        """Training tokens of a bucket of words, and how many distinct ones; no row for other buckets."""
        found: list[tuple[int, int]] = []
        if asked.column("bucket")[0].as_py() < self.offsets[1]:
            keys, counts, _ = self._bucket(asked)
            found.append((int(counts.sum()), len(np.unique(keys[counts > 0]))))
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["n_train", "n_distinct"])


class Automaton:
    """The part of the model that a block's texts can walk.

    A state is a context: none, the start of a text, or an n-gram shorter than the longest.  The arc
    that a state has for a token is the n-gram of both, so arcs are found by their place in the line:
    ``arcs[n]`` has the weight of the n-gram that ends at a place, not a number where training texts
    lack it, and ``fails[n]`` that of the failure arc of the state before it.
    """

    def __init__(self, line: Line, strengths: Sequence[float], added: float, n_train: int, n_distinct: int):
        self.line, self.order = line, 1 + len(strengths)
        words = line.grams(1)
        seen = words.total
        prob = (seen + added) / (n_train + added * (n_distinct + 1))
        # How often training texts have the context that ends at a place: a text starts as often as one ends.
        end = np.searchsorted(words.distinct, _END)
        count = np.where(words.number >= 0, seen[words.number], seen[end] if len(seen) else 0)
        self.known = (seen > 0)[words.number]
        self.arcs, self.fails = [np.log10(prob)[words.number]], [np.zeros(0)]
        for n, m in enumerate(strengths, 2):
            grams, total, shorter = line.grams(n), line.grams(n).total, line.grams(n - 1)
            prob = (total + m * prob[shorter.number[grams.place]]) / (count[grams.place - 1] + m)
            have = grams.number >= 0
            arc = np.full(len(have), np.nan)
            arc[have] = np.where(total > 0, np.log10(prob), np.nan)[grams.number[have]]
            self.arcs.append(arc)
            self.fails.append(np.log10(m / (np.roll(count, 1) + m)))
            count = np.where(have, total[grams.number] if len(total) else 0, 0)

    def walk(self, start: int, n: int) -> float:
        """The log10 probability of the text whose ``n`` tokens follow the place ``start``."""
        own = slice(start + 1, start + 1 + n)
        arcs, fails = [a[own].tolist() for a in self.arcs], [f[own].tolist() if len(f) else f for f in self.fails]
        known, most = self.known[own].tolist(), self.order - 1
        length, total = 1, 0.0  # tokens of the context
        for at in range(n):
            longer = length
            while longer and (weight := arcs[longer][at]) != weight:
                total += fails[longer][at]
                longer -= 1
            if longer:
                total += weight
                length = longer + 1 if longer < most else most
            else:
                total += arcs[0][at]
                length = 1 if known[at] else 0
        return total


def score_texts(
    df: DataFrame, strengths: Sequence[float] = STRENGTHS, added: float = ADDED, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts that are not held out are learned from; all are scored.  Tokens are a text's words, with
    A-Z in lower case, and one end.  ``base_score`` is the log10 probability by single tokens,
    ``score`` that by the model, whose longest n-grams have one token more than ``strengths`` has
    entries.  A null text counts as empty and has only the end.  A missing identifier counts as the
    empty one, which is held out.  Repeated rows are learned from and scored each; without training
    texts all tokens are equally unknown.  An empty input gives no rows; further columns play no
    part.  Words are told apart by 64 bits, longer n-grams by ``bits_for``
    the size.
    """
    order = 1 + len(strengths)
    if order < 2:
        raise ValueError("at least pairs are needed")
    size = text_bytes(df, text_col)
    n_blocks, bits = parts_for(size, for_memory(df, BLOCK_BYTES)), bits_for(size)
    exchange = Exchange([parts_for(size, for_memory(df, each), 4) for each in (WORD_BYTES, PAIR_BYTES, *[LONGER_BYTES] * (order - 2))], bits)
    docs = deal(df, n_blocks, dealt_parts(df, size, n_blocks), id_col, text_col)
    by_block = docs.groupBy("block")

    def line_of(table: pa.Table) -> tuple[int, list[int | None], Line]:
        block, ids, texts = in_order(table)
        return block, ids, Line(ids, texts, folds, bits)

    def first(table: pa.Table) -> pa.Table:
        block, _, line = line_of(table)
        return exchange.ask(block, line, (1, 2))

    def answer(table: pa.Table) -> pa.Table:
        return exchange.answer(table)

    def totals(table: pa.Table) -> pa.Table:
        return exchange.totals(table)

    def longer(n: int):
        def ask(table: pa.Table, told: pa.Table) -> pa.Table:
            block, _, line = line_of(table)
            exchange.read(line, told, range(2, n))
            return exchange.ask(block, line, (n,))

        return ask

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        _, ids, line = line_of(table)
        exchange.read(line, told, range(1, order + 1))
        n_train, n_distinct = (max(filter(None, told.column(c).to_pylist()), default=0) for c in ("n_train", "n_distinct"))
        automaton = Automaton(line, strengths, added, n_train, n_distinct)
        base, known, scores = [], [], []
        for start, n in zip(line.starts.tolist(), line.counts.tolist(), strict=True):
            base.append(float(automaton.arcs[0][start + 1 : start + 1 + n].sum()))
            known.append(int(automaton.known[start + 1 : start + 1 + n].sum()))
            scores.append(automaton.walk(start, n))
        columns = [pa.array(ids, pa.int64()), pa.array(line.held_out), pa.array(line.counts, pa.int64()), pa.array(known, pa.int64()), pa.array([n_train] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())]
        return pa.Table.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    asked = by_block.applyInArrow(first, ASK)
    sums = asked.groupBy("bucket").applyInArrow(totals, "n_train long, n_distinct long").agg(F.sum("n_train").alias("n_train"), F.sum("n_distinct").alias("n_distinct"))
    told = asked.groupBy("bucket").applyInArrow(answer, ANSWER).crossJoin(F.broadcast(sums)).select("block", "bucket", "bits", "n_train", "n_distinct")
    for n in range(3, order + 1):
        more = by_block.cogroup(told.groupBy("block")).applyInArrow(longer(n), ASK).groupBy("bucket").applyInArrow(answer, ANSWER)
        told = told.unionByName(more.selectExpr("*", "CAST(NULL AS LONG) AS n_train", "CAST(NULL AS LONG) AS n_distinct"))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(finish, SCHEMA)
