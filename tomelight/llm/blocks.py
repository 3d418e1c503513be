"""Exchange of packed keys between blocks of documents and buckets of keys.

Documents are dealt into blocks by identifier and text and each block works on whole arrays.  What a
block wants to know about its keys goes out as one packed row for each bucket of keys and comes
back as one packed row of bits, so a shuffle carries few bytes a key and a key that very many
documents have is sent once a block.  The three passes over the blocks read one and the same
exchange of the texts, since they are part of one plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, spread

ASK = "block int, bucket int, body binary, extra binary"
ANSWER = "block int, bucket int, bits binary"
_ASK = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: A key with more places than this is hot, if what surrounds it differs: of 64 values of a hash of
#: the surroundings, more than so many occur, which about 55 different ones give.
HOT_PLACES, HOT_CONTEXTS = 20_000, 36


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    x ^= x >> _S33
    return x


def powers(base: int, n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first ``n`` powers of an odd ``base`` and of its inverse, modulo 2**64."""
    found = _kept.get(base)
    if found is None or len(found[0]) < n:
        size = max(n, 1 << 16, 2 * len(found[0]) if found else 0)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        found = _kept[base] = tuple(both)
    return found[0][:n], found[1][:n]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def put_counts(counts: np.ndarray) -> bytes:
    """A byte a count, and eight more for those of 255 or above."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def get_counts(packed: bytes, n: int) -> np.ndarray:
    """``n`` counts from the start of ``packed``."""
    counts = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    large = counts == 255
    counts[large] = np.frombuffer(packed, "<i8", int(large.sum()), n)
    return counts


def deal(df: DataFrame, n_blocks: int, n_parts: int, id_col: str, text_col: str) -> DataFrame:
    base = id_and_text(df, id_col, text_col)
    return base.select(spread(base, n_blocks, "doc_id", "text").alias("block"), "doc_id", "text").repartition(n_parts, "block")


def known_ids(ids: list[int | None]) -> np.ndarray:
    """Identifiers for comparing; a missing one counts as the largest."""
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)


def in_order(docs: pa.Table) -> tuple[int, list[int], list[bytes]]:
    """Block, identifiers and texts of a block's documents, always in the same order."""
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = [t.as_buffer().to_pybytes() for t in docs.column("text")]
    return docs.column("block")[0].as_py(), docs.column("doc_id").to_pylist(), texts


def by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that sorts distinct ``keys`` by bucket, and (bucket, from, to) in that order."""
    if not len(keys):
        return np.zeros(0, np.int64), []
    bucket = ((keys >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return order, [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]


def ask_rows(block: int, rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array([block] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        schema=_ASK,
    )


def answer_rows(asked: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_arrays([asked.column("block").combine_chunks(), asked.column("bucket").combine_chunks(), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], schema=_ANSWER)


def answers(table: pa.Table) -> dict[int, np.ndarray]:
    return {b: np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool) for b, bits in zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True)}


def _short(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key, beside those that choose its bucket."""
    return (mix(keys ^ _M2) >> np.uint64(32)).astype(np.uint32)


def ask_repeated(block: int, keys: np.ndarray, many: np.ndarray, n_buckets: int) -> pa.Table:
    """Ask which of a block's distinct ``keys`` occur elsewhere; ``many`` marks those with several places here.

    Keys only propose, so 32 bits beside the bucket do: a chance equality costs a comparison.
    """
    order, parts = by_bucket(keys, n_buckets)
    short, many = _short(keys[order]), many[order]
    return ask_rows(block, [(b, short[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for b, i, j in parts])


def _repeated(bodies: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key asked about: its number among distinct ones, the places of each distinct one, and whether it has two."""
    key, place = np.unique(np.concatenate(bodies), return_inverse=True)
    places = np.bincount(place, counts, len(key))
    return place, places, (places > 1)[place]


def answer_repeated(asked: pa.Table) -> pa.Table:
    """For each key that a block asked about: does it have a second place, there or elsewhere?"""
    bodies = [np.frombuffer(b, np.uint32) for b in asked.column("body").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(b)] for x, b in zip(asked.column("extra").to_pylist(), bodies, strict=True)]
    _, _, hit = _repeated(bodies, 1 + np.concatenate(many))
    cuts = np.cumsum([0, *map(len, bodies)])
    return answer_rows(asked, [hit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])


def _put_marks(several: np.ndarray, places: np.ndarray, around: np.ndarray) -> bytes:
    """Flags, counts, and the surroundings: the bit's number for a single place, all 64 bits for more."""
    one = places == 1
    return np.packbits(several).tobytes() + put_counts(places) + (np.bitwise_count(around[one] - np.uint64(1))).astype(np.uint8).tobytes() + around[~one].astype("<u8").tobytes()


def _get_marks(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flags = (n + 7) // 8
    several = np.unpackbits(np.frombuffer(packed, np.uint8, flags))[:n]
    places = get_counts(packed[flags:], n)
    one = places == 1
    at = flags + n + 8 * int((places >= 255).sum())
    around = np.empty(n, np.uint64)
    around[one] = np.uint64(1) << np.frombuffer(packed, np.uint8, int(one.sum()), at).astype(np.uint64)
    around[~one] = np.frombuffer(packed, "<u8", offset=at + int(one.sum()))
    return several, places, around


def ask_marks(block: int, keys: np.ndarray, several: np.ndarray, places: np.ndarray, around: np.ndarray, n_buckets: int) -> pa.Table:
    """As ``ask_repeated``, and tell of each key how many places it has here, and which of 64 values what surrounds them hashes to."""
    order, parts = by_bucket(keys, n_buckets)
    short, several, places, around = _short(keys[order]), several[order], places[order], around[order]
    return ask_rows(block, [(b, short[i:j].tobytes(), _put_marks(several[i:j], places[i:j], around[i:j])) for b, i, j in parts])


def answer_marks(asked: pa.Table) -> pa.Table:
    """Two answers a key: does it occur elsewhere, or in several documents of the block?  Is it hot?"""
    bodies = [np.frombuffer(b, np.uint32) for b in asked.column("body").to_pylist()]
    several, places, around = (np.concatenate(x) for x in zip(*(_get_marks(x, len(b)) for x, b in zip(asked.column("extra").to_pylist(), bodies, strict=True)), strict=True))
    place, _, hit = _repeated(bodies, 1 + several)
    often = np.bincount(place, places) > HOT_PLACES
    hot = often[place]
    if hot.any():
        order = np.argsort(place[hot], kind="stable")
        key, first = np.unique(place[hot][order], return_index=True)
        often[key] = np.bitwise_count(np.bitwise_or.reduceat(around[hot][order], first)) > HOT_CONTEXTS
        hot = often[place]
    cuts = np.cumsum([0, *map(len, bodies)])
    return answer_rows(asked, [np.concatenate((hit[a:b], hot[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)])


def read_repeated(keys: np.ndarray, told: dict[int, np.ndarray], n_buckets: int) -> np.ndarray:
    """The answers for distinct ``keys``, in their order."""
    out = np.zeros(len(keys), bool)
    order, parts = by_bucket(keys, n_buckets)
    for b, i, j in parts:
        out[order[i:j]] = told[b][: j - i]
    return out


def read_marks(keys: np.ndarray, told: dict[int, np.ndarray], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Both answers for distinct ``keys``, in their order."""
    repeated, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order, parts = by_bucket(keys, n_buckets)
    for b, i, j in parts:
        repeated[order[i:j]], hot[order[i:j]] = told[b][: j - i], told[b][j - i : 2 * (j - i)]
    return repeated, hot


def through_buckets(asks: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return asks.groupBy("bucket").applyInArrow(answer, ANSWER)
