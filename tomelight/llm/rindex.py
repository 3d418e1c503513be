"""A run-length index of byte strings: run-compressed Burrows-Wheeler transform with sampled run ends."""

from __future__ import annotations

import numpy as np


def _ranked(key: np.ndarray) -> np.ndarray:
    """Each value's rank: how many are less."""
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(key))))
    return rank


def _refine(rank: np.ndarray, second: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Ranks by (rank, second) for positions ``among``, the ones whose rank others share; returns the still shared."""
    key = rank[among] * most + second
    order = np.argsort(key)
    key, where = key[order], among[order]
    old = rank[where]
    place = np.arange(len(key))
    group = np.concatenate(([True], old[1:] != old[:-1]))
    base = np.maximum.accumulate(np.where(group, place, 0))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.maximum.accumulate(np.where(new, place, 0))
    rank[where] = old + first - base
    alone = new & np.concatenate((new[1:], [True]))
    return where[~alone]


class Starts:
    """Finds which of the sorted ``start`` positions below ``n`` is the last up to a given one.

    It takes a bit a position and a count for each 64 of them.
    """

    def __init__(self, start: np.ndarray, n: int):
        self.bits = np.zeros((n >> 6) + 1, np.uint64)
        np.bitwise_or.at(self.bits, start >> 6, np.uint64(1) << (start & 63).astype(np.uint64))
        ones = np.bitwise_count(self.bits).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def __call__(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        upto = np.uint64((1 << 64) - 1) >> (63 - (place & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.bits[word] & upto) - 1


class RunIndex:
    """Over ``strings``, each ended by a terminator of its own, below all bytes.

    Kept after building: the transform's runs (byte, start, how many of the byte come before), the
    text positions at both ends of each run, the text, and for suffixes of at least ``length``
    bytes the ranges of equal prefixes with the least of ``owner`` among their strings.
    """

    def __init__(self, strings: list[bytes], owner: np.ndarray, length: int):
        if length < 7:
            raise ValueError("windows need 7 bytes at least")
        self.length = length
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        n = int(sizes.sum()) + len(strings)
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        sid = np.repeat(np.arange(len(strings)), sizes + 1)
        left = ends[sid] - np.arange(n)  # bytes before the string's end
        code = text.astype(np.int64) + 1
        code[ends] = 0
        # Order by seven codes at once, then by doubling; a terminator orders by its string.
        wide = np.concatenate((code, np.zeros(8, np.int64)))
        key = np.zeros(n, np.int64)
        for k in range(7):
            key |= np.where(left >= k, wide[k : k + n], 0) << (9 * (6 - k))
        rank = _ranked(key)
        shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        width, alike = 7, None
        while True:
            if width <= length <= 2 * width:
                alike = (width, rank.copy())
            if alike is not None and not len(shared):
                break
            second = np.where(left[shared] < width, sid[shared], len(strings) + rank[np.minimum(shared + width, n - 1)])
            if len(shared):
                shared = _refine(rank, second, shared, n + len(strings) + 1)
            width *= 2
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        before = np.where(suffix > 0, code[suffix - 1], 0)
        start = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        end = np.append(start[1:], n) - 1
        self.n, self.code = n, np.concatenate((code, np.zeros(length + 1, np.int64))).astype(np.int16)
        self.run_start, self.run_code = start, before[start]
        self.low, self.high = suffix[start], suffix[end]  # the sampled ends
        size = end - start + 1
        self.run_of = Starts(start, n)
        by_code = np.lexsort((start, self.run_code))
        sized = np.cumsum(size[by_code]) - size[by_code]
        codes, first = np.unique(self.run_code[by_code], return_index=True)
        self.total = np.zeros(258, np.int64)  # positions whose suffix starts with a lesser code
        np.add.at(self.total, self.run_code + 1, size)
        self.total = np.cumsum(self.total)[:257]
        self.occ = np.empty(len(start), np.int64)
        base = np.zeros(257, np.int64)
        base[codes] = sized[first]
        self.occ[by_code] = sized - base[self.run_code[by_code]]
        self.by_code = by_code
        self.run_key = self.run_code[by_code] * (n + 1) + start[by_code]
        # Ranges of suffixes with equal first ``length`` bytes, and their least owner.
        w, r = alike
        a, b = suffix[:-1], suffix[1:]
        far = length - w
        near = np.minimum(np.arange(n) + far, n - 1)
        same = (left[a] >= length) & (left[b] >= length) & (r[a] == r[b]) & (r[near[a]] == r[near[b]])
        self.range_start = np.flatnonzero(np.concatenate(([True], ~same))) if n else np.zeros(0, np.int64)
        self.range_least = np.minimum.reduceat(owner[sid[suffix]], self.range_start) if n else owner[:0]
        self.range_of = Starts(self.range_start, n)

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def _step(self, run: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The rank of the suffix one byte longer, for ranks within runs of that byte."""
        return self.total[self.run_code[run]] + self.occ[run] + rank - self.run_start[run]

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal bytes at text positions ``a`` and ``b``, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        alive = np.flatnonzero(most > 0)
        for k in range(self.length):
            if not len(alive):
                break
            x = self.code[a[alive] + k]
            alive = alive[(x == self.code[b[alive] + k]) & (x != 0)]
            out[alive] = k + 1
            alive = alive[most[alive] > k + 1]
        return out

    def stream(self, patterns: list[bytes]) -> np.ndarray:
        """The least owner of each window of ``length`` bytes of all ``patterns`` in turn.

        Patterns are read from their ends, all in step.  For each the state is a suffix of the
        index (rank and text position) and the matched length, the matching statistic up to
        ``length``.  Where the transform at the rank has another byte, the nearest runs of the
        byte above and below are tried at their sampled ends and the longer match goes on.
        Windows that match nowhere get the largest integer.
        """
        sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        windows = np.maximum(sizes - self.length + 1, 0)
        offset = np.cumsum(windows) - windows
        found = np.full(int(windows.sum()), np.iinfo(np.int64).max)
        by_size = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(patterns), np.uint8)
        last = np.cumsum(sizes) - 1
        count = len(patterns)
        rank = np.zeros(count, np.int64)
        place = np.full(count, self.low[0] if self.runs else 0, np.int64)
        match = np.zeros(count, np.int64)
        ordered = sizes[by_size]
        for t in range(int(sizes.max(initial=0))):
            k = int(np.searchsorted(-ordered, -t, side="left"))  # patterns longer than t
            who = by_size[:k]
            c = text[last[who] - t].astype(np.int64) + 1
            r, p, m = rank[:k], place[:k], match[:k]
            run = self.run_of(r)
            hit = self.run_code[run] == c
            new_r = self._step(run, r)
            new_p = p - 1
            new_m = np.minimum(m + 1, self.length)
            miss = np.flatnonzero(~hit)
            if len(miss):
                cm, rm, pm, mm = c[miss], r[miss], p[miss], m[miss]
                at = np.searchsorted(self.run_key, cm * (self.n + 1) + rm)
                best, best_rank, best_place = np.full(len(miss), -1, np.int64), rm.copy(), pm.copy()
                for idx, sample, is_end in ((at - 1, self.high, True), (at, self.low, False)):
                    ok = (idx >= 0) & (idx < self.runs)
                    near = self.by_code[np.clip(idx, 0, self.runs - 1)]
                    ok &= self.run_code[near] == cm
                    size = np.full(len(miss), -1, np.int64)
                    size[ok] = self._common(pm[ok], sample[near[ok]], mm[ok])
                    better = size > best
                    edge = np.append(self.run_start[1:], self.n)[near] - 1 if is_end else self.run_start[near]
                    best_rank = np.where(better, self._step(near, edge), best_rank)
                    best_place = np.where(better, sample[near] - 1, best_place)
                    best = np.where(better, size, best)
                new_r[miss], new_p[miss] = best_rank, best_place
                new_m[miss] = np.where(best < 0, 0, np.minimum(best + 1, self.length))
            rank[:k], place[:k], match[:k] = new_r, new_p, new_m
            full = np.flatnonzero((new_m >= self.length) & (windows[who] > 0))
            if len(full):
                found[offset[who[full]] + sizes[who[full]] - 1 - t] = self.range_least[self.range_of(new_r[full])]
        return found
