"""Packing token sequences at balanced cost.

A document's cost in a sequence is linear in its tokens plus quadratic, for attention within the
document.  Each block of documents gets as many sequences as its tokens need; documents go, in
descending order of length, to the sequence of lowest cost that has room, and what fits nowhere is
cut over the sequences of lowest cost.  So only a block's last tokens leave padding.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import dealt_parts, for_memory, id_and_text, parts_for, spread, text_bytes
from .token_counts import PLAIN

LINEAR_COST = 1.0
#: Attention over 1024 tokens costs as much as the rest of the model does for them.
QUADRATIC_COST = 1.0 / 1024
#: Text bytes in a block: about a million tokens, so padding stays near a tenth of a percent.
BLOCK_BYTES = 4e6


class Encoder:
    """Ids as the tokenizers library gives them; plain texts take a faster library's equal path."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text and not PLAIN.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Encoder:
    return Encoder(path, ranks_path, pattern)


def balance(lengths: list[int], capacity: int = 2048, linear: float = LINEAR_COST, quadratic: float = QUADRATIC_COST) -> list[list[tuple[int, int, int, int]]]:
    """Per item, its pieces (start, length, sequence, offset); sequences count from 0.

    ``lengths`` are in any order; ties go by position.  Stretches of a full sequence are cut off
    from the front and stand alone; remainders are packed.
    """
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    n_full, rest = 0, []
    for item, length in enumerate(lengths):
        whole = length // capacity
        for k in range(whole):
            pieces[item].append((k * capacity, capacity, n_full, 0))
            n_full += 1
        if length % capacity:
            rest.append((length % capacity, item, whole * capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    n = -(-sum(r[0] for r in rest) // capacity)
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n)

    def put(item: int, start: int, length: int, at: int) -> None:
        pieces[item].append((start, length, n_full + at, capacity - int(room[at])))
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length

    for length, item, start in rest:
        fits = np.where(room >= length, cost, np.inf)
        at = int(fits.argmin())
        if fits[at] < np.inf:
            put(item, start, length, at)
            continue
        while length:
            at = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(length, int(room[at]))
            put(item, start, part, at)
            start, length = start + part, length - part
    return pieces


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE_TYPE = pa.schema([(f.split()[0], pa.int64()) for f in _PIECES.split(", ")])


def _pack(make_encoder, capacity: int, end_id: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        code = make_encoder()
        block = table.column("block")[0].as_py()
        docs = table.column("doc_id").to_pylist()
        end = np.array([end_id], np.uint32)
        ids = [np.concatenate([code.ids(t.as_py()), end]) for t in table.column("text")]
        rows = []
        for doc, own, parts in zip(docs, ids, balance([len(x) for x in ids], capacity), strict=True):
            for start, length, seq, offset in parts:
                crc = zlib.crc32(own[start : start + length].astype("<u4").tobytes())
                rows.append((doc, start, length, crc, len(own), (block << 32) + seq, offset))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], schema=_PIECE_TYPE)

    return run


def pack(
    df: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: where it comes from and where it lies in which sequence.

    A document is its ids and ``end_id``; every id lies in one piece.  A null text counts as empty
    and gives the single ``end_id``.  Repeated rows are packed each for itself.  An empty input
    gives no rows; further columns play no part.  Blocks are dealt by identifier and text, so rows
    without an identifier spread like others.
    """
    size = text_bytes(df, text_col)
    blocks = parts_for(size, for_memory(df, BLOCK_BYTES))
    base = id_and_text(df, id_col, text_col)
    dealt = base.select(spread(base, blocks, "doc_id", "text").cast("long").alias("block"), "doc_id", "text").repartition(dealt_parts(df, size, blocks), "block")
    make = functools.partial(encoder, path, ranks_path, pattern)
    return dealt.groupBy("block").applyInArrow(_pack(make, capacity, end_id), _PIECES)
