"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated fingerprint bits share a partition; dynamic programming over estimated candidate counts
gives each partition its own threshold, -1 (skip) and up.  With thresholds t1..tm where the sum of
(ti + 1) is the distance plus one, any two fingerprints within the distance differ by at most ti
in some partition i, so probing those and verifying whole fingerprints finds every link.  The
sample below only steers cost: any allocation finds the same links.

Near copies by similarity are first found the same way: fingerprints of their shingles that are linked
make candidates, and sketches of the shingle sets say which of these are similar enough.  Similar texts
may differ in more bits than links do, so what this leaves apart is found by the sketches themselves:
those that differ in so few bins as a link may are equal in one band of bins at least.  By a few bands
every sketch is compared with the least identifier of its group of equal bands; then all bands find the
links between the parties that are left, so copies are not paired again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fill_cores
from .common import id_and_text, parts_for, spread, store
from .components import connected_components

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
BITS = 64
# Near copies by similarity: five words, a similarity of 0.8 (estimated, hence a margin).
NEAR_SHINGLE, SIMILARITY, MARGIN = 5, 0.8, 0.02
SKETCH_BINS = 256
#: Bands of every class in which sketches are compared with their group's least identifier first.
FIRST_BANDS = 6
#: Groups of equal bands up to this size give their pairs (no more than members), larger ones are searched beside their sketches.
PAIRED_GROUP = 3
#: Members of a block of a larger group; every two blocks of different parties are searched together.
GROUP_BLOCK = 4_000
#: Sketches that one searching task should hold.
BUCKET_SKETCHES = 10_000
#: Fingerprints drawn to estimate candidate counts.
SAMPLE = 4000
#: Signatures that one probing task should hold.
BUCKET_SIGNATURES = 400_000
#: A signature that the sample says more fingerprints than this share is split by blocks of bits.
HOT_SIGNATURES = 200_000
#: Groups of equal signatures up to this size are compared by shifts, larger ones by search.
SMALL_GROUP = 48
#: Groups beyond this are first split by blocks of bits.
LARGE_GROUP = 20_000

#: Relative cost of a signature and of a compared pair.
SIGNATURE_COST, PAIR_COST = 20.0, 1.0


_MIX, _STEP, _ALL = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03, (1 << 64) - 1


def shingle_hashes(text: bytes, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash of each shingle of lower-cased (A-Z) words, repeats included; of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` have; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    return majority(shingle_hashes(text, shingle))


def sketch(hashes: np.ndarray) -> bytes:
    """One byte for each of ``SKETCH_BINS`` bins of distinct hashes, from the bin's least; 0 if it is empty.

    Eight bytes follow: the sum of the distinct hashes where at most two bins are filled, else 0.
    """
    least = np.full(SKETCH_BINS, _ALL, np.uint64)
    np.minimum.at(least, (hashes & np.uint64(SKETCH_BINS - 1)).astype(np.int64), hashes >> np.uint64(8))
    bins = np.where(least == np.uint64(_ALL), 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    few = np.unique(hashes).sum(dtype=np.uint64) if np.count_nonzero(bins) <= 2 else np.uint64(0)
    return bins.tobytes() + few.tobytes()


def alike(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two sketched sets; sets that fill two bins or fewer are equal or unlike."""
    x, y = np.frombuffer(a, np.uint8, SKETCH_BINS), np.frombuffer(b, np.uint8, SKETCH_BINS)
    used = int(((x > 0) | (y > 0)).sum())
    if used <= 2:
        return float(a == b)
    same = ((x == y) & (x > 0)).sum() / used
    return max(0.0, (same - 1 / 255) / (1 - 1 / 255))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py().encode("utf-8", "surrogatepass"), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def simhash(df: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long); a null text counts as empty."""
    return fill_cores(id_and_text(df, id_col, text_col)).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bits, correlated ones together."""
    bits = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((0, BITS))
    if len(sample) > 1:
        bits -= bits.mean(axis=0)
        norm = np.sqrt((bits**2).sum(axis=0))
        norm[norm == 0] = 1
        like = np.abs((bits / norm).T @ (bits / norm))
    else:
        like = np.eye(BITS)
    left, parts = list(range(BITS)), []
    for k in range(m, 0, -1):
        size = len(left) // k
        part = [left.pop(0)]
        while len(part) < size:
            part.append(left.pop(int(like[np.ix_(part, left)].sum(axis=0).argmax())))
        parts.append(sorted(part))
    return parts


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def allocate(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of the lowest estimated cost: (bits, threshold), none below 0."""
    best: tuple[float, list] = (math.inf, [])
    pairs = len(sample) * (len(sample) - 1) / 2
    for m in range(1, distance + 2):
        parts = group_bits(sample, m)
        costs = []  # by partition, then threshold + 1
        for bits in parts:
            own = project(sample, bits)
            near = np.zeros(distance + 1)
            for k in range(0, len(own), 500):
                d = np.bitwise_count(own[k : k + 500, None] ^ own[None, :])
                near += np.array([(d == t).sum() for t in range(distance + 1)])
            near[0] -= len(own)
            row, signatures = [0.0], 1.0
            for t in range(distance + 1):
                signatures += math.comb(len(bits), t) if t else 0
                even = sum(math.comb(len(bits), k) for k in range(t + 1)) / 2 ** len(bits)
                share = max(even, near[: t + 1].sum() / 2 / pairs) if pairs else even
                row.append(SIGNATURE_COST * n * signatures + PAIR_COST * n * n / 2 * share)
            costs.append(row)
        # least[s]: lowest cost of the partitions so far at which their thresholds plus one sum to s
        least = [(0.0, [])] + [(math.inf, [])] * (distance + 1)
        for row in costs:
            least = [min(((least[s - k][0] + row[k], [*least[s - k][1], k - 1]) for k in range(s + 1)), key=lambda x: x[0]) for s in range(distance + 2)]
        if least[-1][0] < best[0]:
            best = (least[-1][0], [(b, t) for b, t in zip(parts, least[-1][1], strict=True) if t >= 0])
    return best[1]




def signatures(fps: np.ndarray, plan: list[tuple[list[int], int]], probes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, fingerprint, is_probe of each partition's own value and of the values around it."""
    keys, own, probe = [], [], []
    for k, (bits, t) in enumerate(plan):
        value = project(fps, bits)
        masks = [sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(range(len(bits)), r)] if probes else []
        # Partitions differ in their keys' hashed part, values in the rest.
        for shift, is_probe in ((np.zeros(1, np.uint64), 0), (np.array(masks, np.uint64), 1)):
            key = (value[:, None] ^ shift[None, :]).ravel()
            keys.append((key * _MIX ^ np.uint64((k + 1) * _STEP & _ALL)) * _MIX)
            own.append(np.repeat(fps, len(shift)))
            probe.append(np.full(len(key), is_probe, np.uint8))
    return np.concatenate(keys), np.concatenate(own), np.concatenate(probe)


def hot_keys(sample: np.ndarray, n: int, plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Sorted keys that the sample says more than ``HOT_SIGNATURES`` of ``n`` fingerprints share."""
    if not len(sample):
        return np.zeros(0, np.uint64)
    key, count = np.unique(signatures(sample, plan, probes=False)[0], return_counts=True)
    return key[(count >= 3) & (count / len(sample) * n > HOT_SIGNATURES)]


def split_hot(key: np.ndarray, fps: np.ndarray, probe: np.ndarray, hot: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace entries of hot keys by one for each of ``distance`` + 1 blocks of bits, the block's value in the key.

    Two fingerprints within the distance agree in one block at least, so each pair still meets.
    """
    is_hot = np.isin(key, hot)
    if not is_hot.any():
        return key, fps, probe
    k, f, p = key[is_hot], fps[is_hot], probe[is_hot]
    parts = [(key[~is_hot], fps[~is_hot], probe[~is_hot])]
    width = BITS // (distance + 1)
    for block in range(distance + 1):
        size = BITS - block * width if block == distance else width
        value = (f >> np.uint64(block * width)) & np.uint64((1 << size) - 1)
        parts.append(((k ^ (value * _MIX + np.uint64((block + 1) * _STEP & _ALL))) * _MIX, f, p))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _signature_rows(plan: list[tuple[list[int], int]], n_buckets: int, hot: np.ndarray, distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 2048):
                key, own_fp, is_probe = split_hot(*signatures(fps[at : at + 2048], plan), hot, distance)
                bucket = ((key >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, key, own_fp, is_probe = bucket[order], key[order], own_fp[order], is_probe[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*cuts[1:].tolist(), len(bucket)]
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (key, own_fp, is_probe)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *packed], names=["bucket", "keys", "fps", "probe"])

    return run


def _search(members: np.ndarray, distance: int, out: list[tuple[int, int]], depth: int = 0) -> None:
    """Edges that connect all of ``members`` that are linked within it, one for each member at most."""
    if len(members) > LARGE_GROUP and depth < 3:
        width = BITS // (distance + 1)
        for k in range(distance + 1):
            size = BITS - k * width if k == distance else width
            block = (members >> np.uint64(k * width)) & np.uint64((1 << size) - 1)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for part in np.split(members[order], cuts):
                if 1 < len(part) < len(members):
                    _search(part, distance, out, depth + 1)
                elif len(part) == len(members):
                    _search(part, distance, out, 3)
                    return
        return
    left = members
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                out.extend((int(x), y) for y in found.tolist())
                front.extend(found)


def _stars(pairs: list[np.ndarray], more: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The forest of the given edges as (node, smallest node of its tree)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for a, b in (p for chunk in pairs for p in chunk.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    for a, b in more:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    nodes = [(x, find(x)) for x in list(root)]
    nodes = [(x, r) for x, r in nodes if x != r]
    return np.array([x for x, _ in nodes], np.uint64), np.array([r for _, r in nodes], np.uint64)


def _link(distance: int):
    def run(table: pa.Table) -> pa.Table:
        key, fps, probe = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("fps", np.uint64), ("probe", np.uint8)))
        order = np.lexsort((probe, key))
        key, fps, probe = key[order], fps[order], probe[order]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        sizes = np.diff(np.append(starts, len(key)))
        useful = (probe[starts] == 0) & (sizes > 1)  # own values sort first; probes that meet none are of no use
        pairs, more = [], []
        small = useful & (sizes <= SMALL_GROUP)
        take = np.repeat(small, sizes)
        k, f, p = key[take], fps[take], probe[take]
        shift = 1
        while len(k) > shift:
            same = k[shift:] == k[:-shift]
            if not same.any():
                break
            hit = np.flatnonzero(same & ((p[shift:] == 0) | (p[:-shift] == 0)) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= distance) & (f[shift:] != f[:-shift]))
            pairs.append(np.stack((f[hit], f[hit + shift]), axis=1))
            shift += 1
        for a, n in zip(starts[useful & ~small], sizes[useful & ~small], strict=True):
            _search(np.unique(fps[a : a + n]), distance, more)
        a, b = _stars(pairs, more)
        return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def least_share(similarity: float) -> float:
    """The share of used bins in which sketches of at least this estimated similarity agree."""
    return (similarity * 254 + 1) / 255 - 1e-9


def size_classes(share: float) -> list[int]:
    """Ascending bounds of classes of filled bins: sketches that may link are of one class or of neighbours."""
    ends = [SKETCH_BINS + 1]
    while ends[-1] > 1:
        ends.append(int(share * (ends[-1] - 1)) + 1)
    return ends[::-1]


_TOKENS = np.random.default_rng(SEED).integers(1, _ALL, (SKETCH_BINS, 256), np.uint64)
_TOKENS[:, 0] = 0


def _bands(tokens: np.ndarray, rows: np.ndarray, bands: int, salt: int, take: range, out: list[tuple[np.ndarray, np.ndarray]], again: bool = True) -> None:
    """Append (rows, keys) of the bands in ``take``; an empty band says little, so the other bins are dealt into bands for it."""
    width = tokens.shape[1]
    starts = np.arange(bands) * width // bands
    sums = np.add.reduceat(tokens, starts, axis=1)
    for k in take:
        value = sums[:, k]
        full = (value != 0) | (not again or bands == 1)
        out.append((rows[full], (value[full] * _MIX ^ np.uint64((salt + k + 1) * _STEP & _ALL)) * _MIX))
        if not full.all():
            end = starts[k + 1] if k + 1 < bands else width
            _bands(np.delete(tokens[~full], np.s_[starts[k] : end], axis=1), rows[~full], bands, (salt + k + 1) * 1009, range(bands), out, False)


def band_keys(sketches: np.ndarray, share: float, first: int = 0, end: int = SKETCH_BINS + 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that any two rows that agree in ``share`` of their used bins have a key in common.

    With n bins filled in the lesser sketch, at most n / share are used and (1 - share) of those
    differ; of one band more than that, one is equal in both.  Each class of n, and each class with
    the next, has bands of its own, of which those from ``first`` to before ``end`` are given.
    """
    filled = np.count_nonzero(sketches, axis=1)
    tokens = _TOKENS[np.arange(SKETCH_BINS)[None, :], sketches]
    ends, out = size_classes(share), []
    for c, (low, top) in enumerate(zip(ends, ends[1:], strict=False)):
        bands = int((1 - share) * min(SKETCH_BINS, (top - 1) / share)) + 1
        own = (filled >= low) & (filled < top)
        apart = (own & (filled / share >= top)) | ((filled >= top) & (filled * share <= top - 1))
        for space, take in ((2 * c, own), (2 * c + 1, apart)):
            if take.any() and (space % 2 == 0 or c + 3 <= len(ends)):  # the last class has no next one
                _bands(tokens[take], np.flatnonzero(take), bands, (space + 1) << 20, range(bands)[first:end], out)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, keys = zip(*out, strict=True)
    return np.concatenate(rows), np.concatenate(keys)


def _bins(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH_BINS + 8)[:, :SKETCH_BINS]


_PARTIES = "bucket int, keys binary, ids binary, parties binary"


def _band_rows(share: float, n_buckets: int, end: int):
    """Packed rows of 32 bits of each key beside its bucket (a chance equality costs a comparison), sketch and party."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                row, key = band_keys(_bins(part.column("sketch")), share, 0, end)
                if not len(row):
                    continue
                ids, parties = (part.column(c).to_numpy()[row] for c in ("rep", "party"))
                bucket = ((key >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, key, ids, parties = bucket[order], (key[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ids[order], parties[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*cuts[1:].tolist(), len(bucket)]
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (key, ids, parties)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *packed], names=["bucket", "keys", "ids", "parties"])

    return run


def _grouped(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, identifiers and parties in order of key, party and identifier, each once; starts and sizes of groups of equal keys."""
    key, ids, party = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint32), ("ids", np.int64), ("parties", np.int64)))
    order = np.lexsort((ids, party, key))
    key, ids, party = key[order], ids[order], party[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, party = key[once], ids[once], party[once]
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key, ids, party, starts, np.diff(np.append(starts, len(key)))


def _pivots(table: pa.Table) -> pa.Table:
    """Pairs a, b of the least identifier of each group of equal keys and its other members."""
    _, ids, _, starts, sizes = _grouped(table)
    least = np.repeat(np.minimum.reduceat(ids, starts), sizes) if len(ids) else ids
    pairs = np.unique(np.stack((least, ids), axis=1)[least != ids], axis=0)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


_MET = "a long, b long, others array<int>, members array<long>"


def _meet(table: pa.Table) -> pa.Table:
    """What equal keys bring together of different parties.

    Pairs a, b of small groups.  Of larger ones blocks of members, in order of party: a name of the
    group, the block's number, and the numbers of the blocks to search it with.
    """
    _, ids, party, starts, sizes = _grouped(table)
    mixed = party[starts] != party[starts + sizes - 1]
    take = np.flatnonzero(np.repeat(mixed & (sizes <= PAIRED_GROUP), sizes))
    group = np.repeat(np.arange(len(starts)), sizes)
    pairs = [np.zeros((0, 2), np.int64)]
    for shift in range(1, PAIRED_GROUP):
        one = take[take + shift < len(ids)]
        one = one[(group[one] == group[one + shift]) & (party[one] != party[one + shift])]
        pairs.append(np.sort(np.stack((ids[one], ids[one + shift]), axis=1), axis=1))
    both = np.unique(np.concatenate(pairs), axis=0)
    a, b, others, members = both[:, 0].tolist(), both[:, 1].tolist(), [None] * len(both), [None] * len(both)
    large, seen = mixed & (sizes > PAIRED_GROUP), set()
    for at, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        own, sides = ids[at : at + n], party[at : at + n]
        name = xxhash.xxh64_intdigest(own.tobytes(), SEED)
        if (name, n) in seen:
            continue
        seen.add((name, n))
        cuts = [n * k // math.ceil(n / GROUP_BLOCK) for k in range(math.ceil(n / GROUP_BLOCK) + 1)]
        ends = [(sides[i], sides[j - 1]) for i, j in zip(cuts, cuts[1:], strict=False)]
        for i, (low, high) in enumerate(ends):
            # Two blocks together cover what lies within each; blocks of one and the same party have nothing to find.
            meet = [j for j, e in enumerate(ends) if (j != i or len(ends) == 1) and not low == high == e[0] == e[1]]
            if meet:
                a.append(name - (1 << 64) if name >> 63 else name)
                b.append(i)
                others.append(meet)
                members.append(own[cuts[i] : cuts[i + 1]].tolist())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(others, pa.list_(pa.int32())), pa.array(members, pa.list_(pa.int64()))], names=["a", "b", "others", "members"])


def search_sketches(parties: np.ndarray, bins: np.ndarray, share: float, out: list[tuple[int, int]]) -> None:
    """Links that connect all parties of which some rows are linked within these, one for each party at most.

    Rows of one party count as connected and are not compared.  Small parties go first, so a large
    one is compared with what is left at the end.
    """
    _, inverse, size = np.unique(parties, return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, size[inverse]))
    parties, bins = parties[order], np.ascontiguousarray(bins[order])
    rows = np.split(np.arange(len(parties)), np.flatnonzero(np.diff(parties)) + 1)
    own_rows = {int(parties[r[0]]): r for r in rows}
    filled = np.count_nonzero(bins, axis=1)
    left, rest, rest_filled = np.arange(len(parties)), bins, filled
    while len(left):
        joined = {int(parties[left[0]])}
        front = own_rows[int(parties[left[0]])].tolist()
        stay = parties[left] != parties[left[0]]
        left, rest, rest_filled = left[stay], rest[stay], rest_filled[stay]
        while front and len(left):
            x = front.pop()
            own = bins[x] > 0
            same = np.count_nonzero((rest == bins[x]) & own, axis=1)
            used = rest_filled + filled[x] - np.count_nonzero((rest > 0) & own, axis=1)
            near = (same >= share * used) & (used > 2)
            if near.any():
                found = set(parties[left[near]].tolist()) - joined
                joined |= found
                out.extend((int(parties[x]), y) for y in found)
                for y in found:
                    front.extend(own_rows[y].tolist())
                stay = ~np.isin(parties[left], list(found))
                left, rest, rest_filled = left[stay], rest[stay], rest_filled[stay]


def _search_groups(share: float):
    def run(table: pa.Table) -> pa.Table:
        group = np.stack([table.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
        party, bins = table.column("party").to_numpy(), _bins(table.column("sketch"))
        order = np.lexsort(group.T)
        cuts = np.flatnonzero((np.diff(group[order], axis=0) != 0).any(axis=1)) + 1
        edges: list[tuple[int, int]] = []
        for part in np.split(order, cuts):
            search_sketches(party[part], bins[part], share, edges)
        a, b = _stars([], [(x & _ALL, y & _ALL) for x, y in edges])
        return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _linked_pairs(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The parties a, b of those ``pairs`` of sketches that are similar enough."""
    left = nodes.select(F.col("rep").alias("a"), F.col("sketch").alias("x"), F.col("party").alias("p"))
    right = nodes.select(F.col("rep").alias("b"), F.col("sketch").alias("y"), F.col("party").alias("q"))
    both = pairs.distinct().join(left, "a").join(right, "b").select(F.col("p").alias("a"), F.col("q").alias("b"), "x", "y")
    return both.mapInArrow(_verified(least), "a long, b long")


def _banded(nodes: DataFrame, n_nodes: int, share: float, end: int) -> DataFrame:
    n_bands = 2 * min(int((1 - share) * SKETCH_BINS) + 1, end)
    return nodes.mapInArrow(_band_rows(share, parts_for(n_nodes * n_bands, BUCKET_SIGNATURES, 4), end), _PARTIES).groupBy("bucket")


def _print_links(nodes: DataFrame, n_nodes: int, least: float) -> DataFrame:
    """Links of sketches whose fingerprints are equal or linked within ``DISTANCE``, each with the least identifier of its own and of its linked fingerprints."""
    firsts = store(nodes.groupBy("fp").agg(F.min("rep").alias("first")), "reps")
    edges = _fingerprint_edges(firsts.select("fp"), DISTANCE)
    linked = edges.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = nodes.join(firsts, "fp").filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    return _linked_pairs(linked.unionByName(equal), nodes, least)


def _first_links(nodes: DataFrame, n_nodes: int, least: float) -> DataFrame:
    """Links of sketches with the least identifier of a group of equal bands; they only spare later work."""
    pairs = _banded(nodes, n_nodes, least_share(least), FIRST_BANDS).applyInArrow(_pivots, "a long, b long")
    return _linked_pairs(pairs, nodes, least)


def _party_links(nodes: DataFrame, n_nodes: int, least: float) -> DataFrame:
    """Edges a, b between parties of ``nodes`` (rep, sketch, party) that connect all parties between which there are links."""
    share = least_share(least)
    met = store(_banded(nodes, n_nodes, share, SKETCH_BINS + 1).applyInArrow(_meet, _MET), "met")
    across = _linked_pairs(met.filter("members IS NULL").select("a", "b"), nodes, least)
    # Groups with the same members are the same; a chance equality of names only joins two searches.
    large = met.filter("members IS NOT NULL").dropDuplicates(["a", "b", "members"]).withColumn("other", F.explode(F.col("others").cast("array<bigint>")))
    large = large.select(F.col("a").alias("key"), F.least("b", "other").alias("low"), F.greatest("b", "other").alias("high"), "members")
    held = met.agg(F.sum(F.size("members").cast("long") * F.size("others"))).first()[0] or 0
    searched = large.withColumn("rep", F.explode("members")).drop("members").join(nodes, "rep").withColumn("task", spread(large, parts_for(held, BUCKET_SKETCHES), "key", "low", "high"))
    return across.unionByName(searched.groupBy("task").applyInArrow(_search_groups(share), "a long, b long"))


def _probe_plan(reps: DataFrame, distance: int) -> DataFrame:
    """Signature rows of distinct fingerprints ``reps.fp`` under the cheapest allocation for ``distance``."""
    n = max(reps.count(), 2)
    drawn = reps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r[0] for r in drawn], np.int64).view(np.uint64)
    plan = allocate(sample, n, distance)
    per_fp = sum(sum(math.comb(len(bits), k) for k in range(t + 1)) for bits, t in plan)
    buckets = parts_for(n * per_fp, BUCKET_SIGNATURES, 4)
    hot = hot_keys(sample, n, plan)
    return reps.select("fp").mapInArrow(_signature_rows(plan, buckets, hot, distance), "bucket int, keys binary, fps binary, probe binary")


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py().encode("utf-8", "surrogatepass"), shingle) for t in batch.column("text")]
            prints = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(prints), pa.array([sketch(h) for h in hashes], pa.binary())], names=["doc_id", "text_key", "fp", "sketch"])

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(a.as_py(), b.as_py()) >= least for a, b in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar_rows(df: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key (a hash of the text) and party of the rows of ``df`` that have a near copy."""
    base = fill_cores(id_and_text(df, id_col, text_col)).withColumn("text_key", F.xxhash64("text"))
    least = similarity - MARGIN
    prints = store(base.mapInArrow(_sketches(shingle), "doc_id long, text_key long, fp long, sketch binary"), "sketches")
    # Equal sketches are one node; its number holds once it is stored.
    nodes = prints.groupBy("sketch").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp")).withColumn("rep", F.monotonically_increasing_id())
    nodes = store(nodes.withColumn("party", F.col("rep")), "nodes")
    n_nodes = nodes.count()
    for links in (_print_links, _first_links, _party_links):
        roots = connected_components(links(nodes, n_nodes, least)).withColumnRenamed("node", "party")
        named = nodes.join(roots, "party", "left").select("sketch", "rep", "n", "fp", F.coalesce("root", "party").alias("party"))
        nodes = store(named, "nodes")
    size = nodes.groupBy("party").agg(F.sum("n").alias("size")).filter("size > 1")
    return store(prints.join(nodes.join(size, "party").select("sketch", "party"), "sketch").select("doc_id", "text_key", "party"), "similar")


def similar_groups(df: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of the rows of ``df`` that have a near copy by similarity.

    A link is a pair of texts whose shingle sets, by sketches, are similar enough, less ``MARGIN``;
    bands of the sketches find every such pair, whatever the size of the input or of a group.  The
    component's identifier is its smallest; a missing one is so only if all are missing.  Texts
    without words (null ones too) have no near copies but each other.  Repeated rows are copies of
    each other and each give a row; rows that share an identifier but not the text are rows of their
    own.  An empty table gives no rows; further columns play no part.
    """
    rows = _similar_rows(df, shingle, similarity, id_col, text_col)
    least = rows.groupBy("party").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "party").select("doc_id", "component_id")


def drop_similar(df: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, of which one document of each group of near copies stays.

    It is the one of the smallest identifier (a missing one counts as the largest), then of the least
    hash of the text; rows that share both stay together, as exact deduplication comes before.  An
    empty table gives an empty one.
    """
    rows = _similar_rows(df, shingle, similarity, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    first = rows.groupBy("party").agg(F.min(place).alias("first"))
    gone = rows.join(first, "party").filter(place != F.col("first")).select(F.col("doc_id").alias("_near_id"), F.col("text_key").alias("_near_key")).distinct()
    key = F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit("")))
    return df.join(gone, df[id_col].cast("long").eqNullSafe(gone["_near_id"]) & (key == gone["_near_key"]), "left_anti")


def _fingerprint_edges(reps: DataFrame, distance: int) -> DataFrame:
    """a, b: edges that connect all of the distinct fingerprints ``reps.fp`` that have links within ``distance``."""
    return _probe_plan(reps, distance).groupBy("bucket").applyInArrow(_link(distance), "a long, b long")


def linked_fingerprints(reps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, root for distinct fingerprints ``reps.fp`` that have a link within ``distance``."""
    return connected_components(_fingerprint_edges(reps, distance)).select(F.col("node").alias("fp"), "root")


def near_groups(df: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most ``distance`` bits; component_id is the
    smallest doc_id reachable over links.  Null and empty texts have fingerprint zero and link like
    any other.  Missing identifiers are never the smallest unless all of a component are missing.
    Equal fingerprints are one node, so copies cost no pairs.  An empty input gives no
    rows; repeated identifiers each give a row; further columns play no part.
    """
    prints = store(simhash(df, shingle, id_col, text_col), "prints")
    reps = store(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = linked_fingerprints(reps, distance)
    rooted = reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = store(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, of which each group's smallest identifier stays.  An empty table gives an empty one.

    Rows that share an identifier, or have none, stay or go together.
    """
    kept = near_groups(df, shingle, distance, id_col, text_col).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return df.join(kept, df[id_col].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")
