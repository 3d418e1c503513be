"""The near stage finds every pair that its sketches link: template families, group sizes, repeated lines."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import frame
from tomelight.llm import simhash

LEAST = simhash.SIMILARITY - simhash.MARGIN


def sketch_of(text: str) -> bytes:
    return simhash.sketch(simhash.shingle_hashes(text.encode(), simhash.NEAR_SHINGLE))


def brute(rows: list[tuple[int, str]]) -> dict[int, int]:
    """Component of each row that has a link, by comparing all pairs of sketches."""
    sketches, root = [sketch_of(t) for _, t in rows], list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for i in range(len(rows)):
        for j in range(i):
            if simhash.alike(sketches[i], sketches[j]) >= LEAST:
                linked |= {i, j}
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in linked}


def groups(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}


def families(seed: int, n: int) -> list[tuple[int, str]]:
    """Texts of a few templates that share most of their words, each with its own part, and edited copies of some."""
    rng, rows = random.Random(seed), []
    templates = [[f"t{t}w{j}" for j in range(size)] for t, size in enumerate((40, 130, 300))]
    for k in range(n):
        if rows and rng.random() < 0.3:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.choice([1, 1, 2, len(w) // 40 + 1, len(w) // 30 + 1])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        else:
            w = rng.choice(templates)
            w = [*w, *(f"o{rng.randrange(10**6)}" for _ in range(rng.choice([len(w) // 8, len(w) // 4, len(w) // 3])))]
        rows.append((k, " ".join(w)))
    return rows


def test_template_families_against_all_pairs(spark):
    rows = families(3, 700)
    want = brute(rows)
    assert len(want) > 200 and len(set(want.values())) > 20
    assert groups(spark, rows) == want


def test_every_link_shares_a_band():
    rng, share = np.random.default_rng(5), simhash.least_share(LEAST)
    for n in [*range(1, 40), *range(40, 257, 9), 256]:
        x = np.zeros(simhash.SKETCH_BINS, np.uint8)
        x[rng.permutation(simhash.SKETCH_BINS)[:n]] = rng.integers(1, 256, n)
        for _ in range(20):
            y, at = x.copy(), rng.permutation(simhash.SKETCH_BINS)
            for k in at:  # as many changed, added and emptied bins as a link may have
                z = y.copy()
                z[k] = rng.choice([0, int(x[k]) % 255 + 1])
                used = ((x > 0) | (z > 0)).sum()
                if ((x == z) & (x > 0)).sum() >= share * used:
                    y = z
            row, key = simhash.band_keys(np.stack((x, y)), share)
            assert (x == y).all() or set(key[row == 0]) & set(key[row == 1])


def packed(keys, ids, parties) -> pa.Table:
    return pa.table({n: [np.asarray(x, t).tobytes()] for n, x, t in (("keys", keys, np.uint32), ("ids", ids, np.int64), ("parties", parties, np.int64))})


def test_members_of_every_two_blocks_meet(monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_BLOCK", 10)
    out = simhash._meet(packed([9] * 35, range(35), range(35))).to_pylist()
    assert [(r["b"], r["others"]) for r in out] == [(0, [1, 2, 3]), (1, [0, 2, 3]), (2, [0, 1, 3]), (3, [0, 1, 2])]
    assert sorted(i for r in out for i in r["members"]) == list(range(35))


def test_blocks_of_one_party_do_not_meet(monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_BLOCK", 10)
    out = simhash._meet(packed([9] * 40, range(40), [5] * 30 + [6] * 10)).to_pylist()
    assert [(r["b"], r["others"]) for r in out] == [(0, [3]), (1, [3]), (2, [3]), (3, [0, 1, 2])]


def test_texts_of_one_fingerprint(spark):
    own = [" ".join(f"d{d}w{j}" for j in range(90)) for d in range(4)]
    rows = [(k, "again " * 400 + t) for k, t in enumerate([own[0], own[1], own[2], own[1] + " end", own[2] + " end", own[3]])]
    assert len({simhash.fingerprint(t.encode(), simhash.NEAR_SHINGLE) for _, t in rows}) == 1
    assert groups(spark, rows) == {1: 1, 3: 1, 2: 2, 4: 2}


def test_pairs_and_groups_of_one_party_are_not_given_out():
    out = simhash._meet(packed(np.repeat(np.arange(4), [3, 20, 20, 20]), [*range(3), *range(40), *range(20, 40)], [0, 0, 2, *[7] * 20, *[k // 10 for k in range(20)] * 2])).to_pylist()
    assert [(r["a"], r["b"]) for r in out if r["members"] is None] == [(0, 2), (1, 2)]
    assert [r["members"] for r in out if r["members"]] == [list(range(20, 40))]  # the same group by two keys is given once


def test_pivots():
    out = simhash._pivots(packed([1, 1, 1, 2, 3, 3], [5, 4, 9, 7, 4, 9], [5, 4, 9, 7, 4, 9])).to_pylist()
    assert [(r["a"], r["b"]) for r in out] == [(4, 5), (4, 9)]


def test_search_links_parties():
    rng, share = np.random.default_rng(1), simhash.least_share(LEAST)
    bins = rng.integers(1, 256, (6, simhash.SKETCH_BINS)).astype(np.uint8)
    bins[3], bins[4] = bins[0], bins[1]  # rows 0 and 3, 1 and 4 are linked; 1 and 3 are of one party
    edges: list[tuple[int, int]] = []
    simhash.search_sketches(np.array([10, 20, 30, 20, 40, 50]), bins, share, edges)
    assert {frozenset(e) for e in edges} == {frozenset((10, 20)), frozenset((20, 40))}


def test_few_first_bands_change_nothing(spark, monkeypatch):
    rows = families(4, 250)
    want = brute(rows)
    for n in (1, 200):
        monkeypatch.setattr(simhash, "FIRST_BANDS", n)
        assert groups(spark, rows) == want


def test_fingerprints_find_copies_first(spark):
    """The near stage links fingerprints and then looks at sketches; equal fingerprints of unlike texts stay apart."""
    rng = random.Random(5)
    texts = []
    for k in range(30):
        w = [f"b{k}w{j}" for j in range(400)]
        texts += [" ".join(w), " ".join([*w[:200], "edit", *w[201:]])]
    line = "same words again and again "
    texts += [line * 60 + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3)]
    hashes = [simhash.shingle_hashes(t.encode(), simhash.NEAR_SHINGLE) for t in texts]
    rows = [(simhash.sketch(h), k, int(np.uint64(simhash.majority(h)).astype(np.int64)), k) for k, h in enumerate(hashes)]
    nodes = spark.createDataFrame([(bytearray(s), k, f, p) for s, k, f, p in rows], "sketch binary, rep long, fp long, party long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash._print_links(nodes, len(rows), LEAST).collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(30)} and len(got) >= 20
